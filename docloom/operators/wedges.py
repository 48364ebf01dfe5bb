"""Wedges of a graph summed up by blocks of names: the lists of neighbours travel, and pairs are only ever made in a task's arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What names have in common is summed up for so many wedges at a time; cells are dense up to DENSE for each wedge.
BATCH, DENSE = 1_000_000, 8

SCHEMA = "id int, partner int, adamic_adar double, low double, high double, exact boolean"


def flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a column of lists; a null list is empty."""
    lengths = np.array(pc.fill_null(pc.list_value_length(column), 0).to_numpy(), dtype=np.int64)
    return np.asarray(pc.list_flatten(column).to_numpy(), dtype=kind), lengths


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, one range after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def sums(keys: np.ndarray, worth: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys (below ``cells``) in order and the sum of what each is worth."""
    if cells <= DENSE * len(keys) and worth.min() > 0:
        found = np.bincount(keys, worth, cells)
        at = np.flatnonzero(found)
        return at, found[at]
    at, which = np.unique(keys, return_inverse=True)
    return at, np.bincount(which, worth, len(at))


def rounded(score: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(score * 10.0**digits + 0.5).astype(np.int64)


def best_of_block(n: int, digits: int, margin: float) -> Callable[[pa.Table], pa.Table]:
    """The n best partners of each name of a block, or those that may be among them.

    Rows are a name's own neighbours (kind 0: id, ids, their scores by edges), neighbours of those (1: id, degree, class, ids)
    and partners known beforehand with a sum that they have at least (2: id, ids, sums). With ``parts`` above 1
    only partners of this part are looked at. Names with a rule leave out wedges through their largest neighbours, worth
    ``skipped`` together, so their scores lie between ``low`` and ``high``; the others are exact.
    """

    def run(rows: pa.Table) -> pa.Table:
        out = list(pieces(rows))
        columns = [np.concatenate(c) if out else np.zeros(0) for c in (zip(*out, strict=True) if out else [()] * 6)]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
        return pa.table([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)], names=["id", "partner", "adamic_adar", "low", "high", "exact"])

    def pieces(rows: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        kind = rows["kind"].to_numpy()
        own, lists, known = (rows.filter(pa.array(kind == k)) for k in range(3))
        if not len(own):
            return
        part, parts = own["part"][0].as_py(), own["parts"][0].as_py()

        def spread(side: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            to, sizes = flat(side["ids"], np.int64)
            return np.repeat(side["id"].to_numpy().astype(np.int64), sizes), to, flat(side["worth"], np.float64)[0]

        # own neighbours and known partners in order of names
        name, of, direct = spread(own)
        order = np.argsort(name, kind="stable")
        name, of, direct = name[order], of[order], direct[order]
        names, first = np.unique(own["id"].to_numpy().astype(np.int64), return_index=True)
        bound, skipped, from_class, largest = (own[c].to_numpy()[first] for c in ("bound", "skipped", "from_class", "largest"))  # alike in all rows of a name
        known_name, known_to, known_sum = spread(known)
        order = np.argsort(known_name, kind="stable")
        known_name, known_to, known_sum = known_name[order], known_to[order], known_sum[order]

        # partners are numbered densely, in order; lists lie one after the other, those of a large neighbour in several rows
        lists = lists.take(pa.array(np.argsort(lists["id"].to_numpy(), kind="stable")))
        listed, lengths = flat(lists["ids"], np.int64)
        mine = of % parts == part
        partners = np.unique(np.concatenate([listed, of[mine], known_to, names]))
        listed, width = np.searchsorted(partners, listed), len(partners)
        list_of = lists["id"].to_numpy().astype(np.int64)
        vias, first = np.unique(list_of, return_index=True)
        starts = np.concatenate([[0], np.cumsum(lengths)])[first] if len(vias) else first
        ends = np.append(starts[1:], len(listed))
        worth, of_class = 1 / np.log(lists["degree"].to_numpy()[first]), lists["class"].to_numpy()[first]

        # links through which wedges lead; a rule leaves out the largest
        at = np.searchsorted(vias, of)
        seen = np.flatnonzero(np.append(vias, -1)[at] == of)
        row, via = np.searchsorted(names, name[seen]), at[seen]
        kept = np.where(np.isnan(from_class[row]), of[seen] != largest[row], of_class[via] < from_class[row])
        row, via = row[kept], via[kept]
        wedges = np.bincount(row, (ends - starts)[via], len(names)).astype(np.int64)
        of, name, direct = of[mine], np.searchsorted(names, name[mine]), direct[mine]
        known_name = np.searchsorted(names, known_name)

        through, begin = np.concatenate([[0], np.cumsum(wedges)]), 0
        while begin < len(names):
            end = max(begin + 1, int(np.searchsorted(through, through[begin] + BATCH, "right")) - 1)
            links, edges, before = (slice(*np.searchsorted(x, [begin, end])) for x in (row, name, known_name))
            v = via[links]
            sizes = ends[v] - starts[v]
            keys = np.repeat((row[links] - begin) * width, sizes) + listed[ranges(starts[v], sizes)]
            met, common = sums(keys, np.repeat(worth[v], sizes), (end - begin) * width)
            edge = (name[edges] - begin) * width + np.searchsorted(partners, of[edges])
            told = (known_name[before] - begin) * width + np.searchsorted(partners, known_to[before])
            keys = np.unique(np.concatenate([met, edge, told]))
            total, seen, by_edge = (np.zeros(len(keys)) for _ in range(3))
            total[np.searchsorted(keys, met)] = common
            seen[np.searchsorted(keys, told)] = known_sum[before]
            by_edge[np.searchsorted(keys, edge)] = direct[edges]
            of_name, to = keys // width + begin, partners[keys % width]
            other = to != names[of_name]
            yield best(names, of_name[other], to[other], total[other], seen[other], by_edge[other], bound, skipped)
            begin = end

    def best(names, row, to, total, seen, by_edge, bound, skipped) -> tuple[np.ndarray, ...]:
        aa = np.maximum(total, seen)
        score = lambda x: np.minimum(1.0, np.maximum(by_edge, np.minimum(x / 5, 0.6)))
        low, high = score(aa), score(np.where(skipped[row] > 0, total + skipped[row], aa))
        # rows are in order of name and partner, so a stable sort leaves equal scores in order of partners
        near = np.flatnonzero(high >= bound[row] - margin)
        if len(near):
            near = near[np.argsort((row[near] - row[near[0]] << 32) - rounded(low[near], digits), kind="stable")]
        of, place = row[near], rounded(low[near], digits)
        starts = np.searchsorted(of, of)  # the first row of each row's name
        first = np.arange(len(of)) - starts < n
        # others stay if their score may still reach that of the n-th, where there is one
        nth = np.minimum(starts + n - 1, max(len(of) - 1, 0))
        after = (of[nth] == of) & ((high[near] < place[nth] / 10.0**digits - margin) | (rounded(high[near], digits) == place[nth]) & (to[near] > to[near][nth]))
        keep = first | ~after & (skipped[of] > 0)
        near, of = near[keep], of[keep]
        return names[of], to[near], aa[near], low[near], high[near], skipped[of] == 0

    return run
