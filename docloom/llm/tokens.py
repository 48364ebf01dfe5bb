"""Encoding of texts with the tokenizers library, for use inside tasks."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Entries that a worker keeps of encoded words; beyond it, those met once are forgotten. Bounds memory, not results.
MEMO_WORDS = 900_000
#: Longer words are encoded but not kept.
MEMO_CHARS = 64
#: Texts are encoded in groups of about so many characters.
GROUP_CHARS = 1_000_000
#: After letters, one of these at the end of a part is a pre-token of its own.
ENDS = ".,!?;:"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Byte-level BPE ids of whole texts as little-endian unsigned 32-bit integers.

    The pre-tokenizer of byte-level BPE never joins what stands on both sides of a single blank or newline between two
    non-blank characters. A text is parted there, and the ids of each part are looked up or, if new, encoded by the
    library, thousands of parts in one call. Texts with other white space around a blank or newline are encoded whole.
    The ids are those of the library for the whole text with ``add_special_tokens=False``: strings of added tokens that
    stand in a text give those tokens' ids, as the library finds them before anything else, and what stands between
    them is encoded like a text of its own.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        self.memo_words = memo_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        strings = sorted({t.content for t in added.values()}, key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, strings))) if strings else None
        # plain ones alone: others also look at what stands beside them
        self.added_ids = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)}
        self.added_plain = len(self.added_ids) == len(strings)
        self.memo: dict[str, bytes | None] = {}
        self.again: set[str] = set()
        self.ends = dict(zip(ENDS, self._whole(list(ENDS)), strict=True))
        newline = self._whole(["\n"])[0]
        self.newline = int(np.frombuffer(newline, "<u4")[0]) if len(newline) == 4 else None
        self.model = self.tokenizer.model
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: set[str]) -> None:
        """Puts the ids of each part in the memo; None marks a part that can't be encoded on its own."""
        memo, ends = self.memo, self.ends
        ended = [p for p in parts if p[-1:] in ends and p[:-1].isalpha()]
        rest = parts.difference(ended)
        words = [p for p in rest if p.isalpha()]
        rest.difference_update(words)
        words += [p for p in {p[:-1] for p in ended}.difference(words) if p not in memo]
        tokenize = self.model.tokenize
        for word in words:  # one pre-token each: straight to the model, after the byte-level spelling
            spelt = f"\u0120{word}" if word.isascii() else self.byte_level.pre_tokenize_str(f" {word}")[0][0]
            memo[word] = array("I", [t.id for t in tokenize(spelt)]).tobytes()
        self._encode_parts([p for p in rest if p[:1] != "\n"], "\n ")
        self._encode_parts([p[1:] for p in rest if p[:1] == "\n"], "\n")
        memo.update([(p, memo[p[:-1]] + ends[p[-1]]) for p in ended])

    def _encode_parts(self, parts: list[str], before: str) -> None:
        """Encodes parts, each with ``before`` in front; the newline is not kept for those after a blank."""
        step, kept, memo = 2000, before == "\n", self.memo
        key = "\n" if kept else ""
        groups, joined = [], []
        for i in range(0, len(parts), step):
            group = parts[i : i + step]
            text = before + before.join(group)
            if text.split() != group:  # a part with white space inside or at an end, or an empty one
                memo.update([(key + p, None) for p in group if not p or p[0].isspace() or p[-1].isspace()])
                group = [p for p in group if p and not p[0].isspace() and not p[-1].isspace()]
                text = before + before.join(group)
            if group:
                groups.append(group)
                joined.append(text)
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, dtype="<u4")
            at = 4 * np.flatnonzero(ids == self.newline)
            data = ids.tobytes()
            if len(at) != len(group):
                raise ValueError("parts were not kept apart")
            first = at.tolist() if kept else (at + 4).tolist()
            last = [*at[1:].tolist(), len(data)]
            memo.update([(key + p, data[a:b]) for p, a, b in zip(group, first, last, strict=True)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        if self.newline is None:
            return self._whole([t or "" for t in texts])
        if self.added:
            special = [i for i, t in enumerate(texts) if t and self.added.search(t)]
            if special:
                texts = list(texts)
                found = [self._with_added(texts[i]) for i in special]
                for i in special:
                    texts[i] = ""
                out = self._in_groups(texts)
                for i, ids in zip(special, found, strict=True):
                    out[i] = ids
                return out
        return self._in_groups(texts)

    def _with_added(self, text: str) -> bytes:
        if not self.added_plain:
            return self._whole([text])[0]
        between = self._in_groups(self.added.split(text))
        tokens = [self.added_ids[t] for t in self.added.findall(text)]
        return b"".join(x for pair in zip(between, [*tokens, b""], strict=True) for x in pair)

    def _in_groups(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        begin = size = 0
        for i, t in enumerate(texts):  # a bounded number of words at a time
            size += len(t or "")
            if size >= GROUP_CHARS:
                out += self._encode_group(texts[begin : i + 1])
                begin, size = i + 1, 0
        return out + self._encode_group(texts[begin:])

    def _encode_group(self, texts: list[str | None]) -> list[bytes]:
        parted = [f"\n{t}".replace("\n", " \n").split(" ")[1:] if t else [] for t in texts]
        held = set().union(*parted)
        new = held.difference(self.memo)
        if len(self.memo) + len(new) > self.memo_words:
            kept = self.again | (held - new)
            if len(kept) + len(new) > self.memo_words:
                kept = held - new
            self.memo = {p: self.memo[p] for p in kept}
            self.again = set()
        else:
            self.again |= held - new
        self._learn(new)
        found = self.memo.__getitem__
        out: list[bytes | None] = []
        for parts in parted:
            try:
                out.append(b"".join(map(found, parts))[4:])
            except TypeError:  # a part that is None
                out.append(None)
        whole = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        for part in [p for p in new if len(p) > MEMO_CHARS]:
            del self.memo[part]
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memo_words: int = MEMO_WORDS) -> Encoder:
    """The worker's encoder for a tokenizer file, kept between batches; ``memo_words`` bounds its memory."""
    key = (path, memo_words)
    if key not in _encoders:
        _encoders[key] = Encoder(path, memo_words)
    return _encoders[key]
