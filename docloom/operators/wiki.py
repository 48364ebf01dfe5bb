"""Pages, links between them, and the health of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import wikilinks


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, target): hrefs of anchors."""
    return pages.select(key, F.explode_outer(F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), 1)).alias("target")).where("target IS NOT NULL")


def page_links(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, target, display) of wikilinks."""
    d = pages.select(key, F.posexplode_outer(F.split(text, "\n")).alias("line_no", "line"))
    return d.select(key, (F.col("line_no") + 1).alias("line_no"), F.explode_outer(wikilinks(F.col("line"))).alias("l")).where("l IS NOT NULL").select(key, "line_no", "l.target", "l.display")


def broken(links: DataFrame, pages: DataFrame, target: str, page: str) -> DataFrame:
    return links.join(pages.select(F.col(page).alias(target)).distinct(), target, "left_anti")


def orphans(pages: DataFrame, links: DataFrame, page: str, source: str, target: str) -> DataFrame:
    """Pages with no link to them and none from them."""
    joined = links.select(F.col(source).alias(page)).union(links.select(target)).distinct()
    return pages.join(joined, page, "left_anti").select(page)


def health_score(orphan: Column, sparse: Column, broken_links: Column, missing: Column) -> Column:
    """1 less .05 an orphan, .03 a sparse type, .08 a broken link and .02 an entity without relations; not below 0."""
    return F.round(F.greatest(F.lit(0.0), 1 - 0.05 * orphan - 0.03 * sparse - 0.08 * broken_links - 0.02 * missing), 4)


def sparse_types(entities: DataFrame, kind: str, least: int = 3) -> DataFrame:
    return entities.groupBy(kind).agg(F.count("*").alias("n")).where(F.col("n") < least)


def search(entities: DataFrame, catalog: DataFrame, query: str, limit: int) -> DataFrame:
    """(kind, id, title, total): entities by name, alias or attribute value, then catalog nodes by title or description, ten
    levels deep at most where they have a ``depth``; total counts all hits. A query of one character finds nothing."""
    q = query.lower()
    hit = F.lower("name").contains(q) | F.exists("aliases", lambda a: F.lower(a).contains(q)) | F.exists(F.map_values("attributes"), lambda v: F.lower(v).contains(q))
    if "depth" in catalog.columns:
        catalog = catalog.where("depth <= 10")
    a = entities.where(hit).select(F.lit("entity").alias("kind"), F.col("id").cast("string").alias("id"), F.col("name").alias("title"))
    b = catalog.where(F.lower("title").contains(q) | F.lower(F.coalesce("description", F.lit(""))).contains(q)).select(F.lit("catalog").alias("kind"), F.col("id").cast("string").alias("id"), "title")
    both = a.unionByName(b).where(F.lit(len(query) >= 2))
    return both.orderBy(F.desc("kind"), "id").limit(limit).join(F.broadcast(both.agg(F.count("*").alias("total"))))  # one row


def front_matter(text: Column) -> Column:
    """map of the ``key: value`` lines between the first two ``---`` lines."""
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", "")))))


def entity_pages(entities: DataFrame, relations: DataFrame, events: DataFrame, most_relations: int = 20, most_events: int = 15) -> DataFrame:
    """(name, content): a page for each entity with its relations and dated events."""
    from docloom.operators.fusion import top_of_each

    r = top_of_each(relations.select(F.col("subject").alias("name"), F.concat_ws(" ", F.lit("-"), "predicate", F.concat(F.lit("[["), "object", F.lit("]]"))).alias("line")).distinct(), ["name"], [F.col("line")], most_relations)
    r = r.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("relations"))
    e = top_of_each(events.select("name", F.concat_ws(" ", F.lit("-"), "date", "title").alias("line")).distinct(), ["name"], [F.col("line")], most_events)
    e = e.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("events"))
    none = F.lit("-")
    d = entities.select("name", "type").join(r, "name", "left").join(e, "name", "left")
    return d.select("name", F.concat(F.lit("# "), "name", F.lit("\n**Type:** "), "type", F.lit("\n## Relations\n"), F.coalesce("relations", none), F.lit("\n## Timeline\n"), F.coalesce("events", none)).alias("content"))


def catalog_entities(catalog: DataFrame, entities: DataFrame) -> DataFrame:
    """(node, entity): catalog nodes (id, title) and the entities (id, name, aliases) of that name or alias."""
    names = entities.select(F.col("id").alias("entity"), F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).distinct()
    return catalog.select(F.col("id").alias("node"), "title").join(names, F.col("title") == F.col("n")).select("node", "entity")


def pages_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, meta, body): pages with their front matter taken off; the title is its ``title``, else the key."""
    meta = front_matter(F.col(text))
    body = F.when(F.col(text).startswith("---\n"), F.regexp_replace(text, r"(?s)^---\n.*?\n---\n*", "")).otherwise(F.col(text))
    return texts.select(F.col(key), F.coalesce(F.try_element_at(meta, F.lit("title")), F.col(key).cast("string")).alias("title"), meta.alias("meta"), body.alias("body"))


def health(orphans: DataFrame, sparse: DataFrame, broken_links: DataFrame, lonely: DataFrame) -> DataFrame:
    """One row: how many of each there are, and the score."""
    one = F.lit(1).alias("one")
    out = None
    for name, rows in (("orphans", orphans), ("sparse", sparse), ("broken", broken_links), ("lonely", lonely)):
        n = rows.agg(F.count("*").alias(name)).select("*", one)
        out = n if out is None else out.join(F.broadcast(n), "one")  # one row each
    return out.select("orphans", "sparse", "broken", "lonely", health_score(F.col("orphans"), F.col("sparse"), F.col("broken"), F.col("lonely")).alias("score"))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def lookup(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, id, found_by): pages (id, title, catalog_path) by id, else by title, else by path; the least id of several."""
    a = asked.select("asked").distinct()
    tries = [("id", 0), ("title", 1), ("catalog_path", 2)]
    found = None
    for column, place in tries:
        own = a.join(pages.select(F.col("id"), F.col(column).cast("string").alias("asked")), "asked").select("asked", "id", F.lit(place).alias("place"), F.lit(column).alias("found_by"))
        found = own if found is None else found.unionByName(own)
    return found.groupBy("asked").agg(F.min(F.struct("place", "id", "found_by")).alias("b")).select("asked", F.col("b.id").alias("id"), F.col("b.found_by").alias("found_by"))
