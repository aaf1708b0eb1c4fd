"""URL filters: a path-template tree per host, pruned by the labelled purity of its templates.

DataFrame operations only. A URL's path is first generalised by form (numbers become ``{n}``, long hex
names ``{h}``), which turns a host's pages into few raw templates with counts. The tree over those is
then generalised level by level: where a node has many children and none of them has more than a small
share of its distinct URLs, the segment is variable and all of them are one pool, ``*``; else the children with a share of good labels under
``REJECT`` are one pool, ``*low``, those with a higher one another, ``*``, and those without any label a
third, ``*new``, of which nothing is known but its host. A child whose share doesn't differ from its
pool's by more than ``Z`` standard errors is merged with its like, and one that does stays on its own, in
a variable segment too. Whether a segment is variable doesn't change when URLs repeat, or when all
children get more URLs alike. A template is rejected when
its share of good labels, smoothed towards the host's and that towards the whole table's, is under
``REJECT``.

Fixed rules come first: the longest rule that fits decides (equally long ones: the first given).

Defined results: a null URL or one without ``://`` has empty host and path; a page without labels on
its template, host or anywhere is judged by the next wider share (without any labels: allowed); a very
long URL has as many levels as segments, but what a branch has in common is passed in one round; of tied rules the first given counts, a share at ``REJECT`` is
allowed, and of labels that contradict each other the good one; rows may repeat; an empty table gives no
rows; other columns pass by.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm import store

#: (action, host, start of path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: A node with more children than this, none of which has one in SHARE of its distinct URLs, has a variable segment.
CHILDREN, SHARE = 50, 10
Z, SMOOTH, REJECT = 3.0, 4.0, 0.5
#: Bytes of templates up to which their verdicts are broadcast; beyond, joined.
BROADCAST_BYTES = 8 << 20

HOST = r"://([^/?#]*)"
PATH = r"://[^/?#]*([^?#]*)"
NUMBER = r"([0-9]+)[^/0-9]*$"


def host_of(url: str = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(F.col(url), HOST, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its action; null where none fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])) if rules else ():
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def raw_template(path: Column) -> Column:
    """The path with the parts of its segments that look generated replaced by their form."""
    numbers = F.regexp_replace(path, r"(?<=/)[0-9]+(?=(\.[A-Za-z]{1,5})?(/|$))", "{n}")
    return F.regexp_replace(numbers, r"(?<=/)(?=[a-f0-9]*[0-9])[a-f0-9]{8,}(?=(\.[A-Za-z]{1,5})?(/|$))", "{h}")


def templates(pages: DataFrame, labels: DataFrame | None) -> DataFrame:
    """One row for each host and raw template: pages, distinct paths, labelled pages, good ones.

    A page's label is the quality label of the document its path ends in the number of.
    """
    own = pages.select(host_of().alias("host"), path_of().alias("path"))
    own = own.select("host", "path", raw_template(F.col("path")).alias("raw"), F.expr("try_cast(nullif(regexp_extract(path, '" + NUMBER + "', 1), '') as bigint)").alias("number"))
    if labels is None:
        return own.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count_distinct("path").alias("urls"), F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("good"))
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("number")).agg(F.max("quality").alias("quality"))
    counted = own.groupBy("host", "raw", "path", "number").agg(F.count("*").alias("n"))
    joined = counted.join(known, "number", "left")
    seen = F.when(F.col("quality").isNotNull(), F.col("n")).otherwise(0)
    return joined.groupBy("host", "raw").agg(F.sum("n").alias("n"), F.count("*").alias("urls"), F.sum(seen).alias("seen"), F.sum(F.when(F.col("quality") == 1, F.col("n")).otherwise(0)).alias("good"))


def generalise(raw: DataFrame) -> DataFrame:
    """``raw`` with the column ``template``: the branch of the host's tree that each raw template is in.

    A round first takes every branch to where its rows part, by what the least and the greatest of them have
    in common, then through one segment in which they differ; rows that end leave. So there are as many
    rounds as a path has segments in which others differ or end, whatever its length. Each is a table of
    its own in the shared folder, which keeps the plans short.
    """
    segments = F.split(F.expr("substr(raw, 2)"), "/")
    rows = raw.withColumns({"rest": F.when(F.col("raw") == "", F.array().cast("array<string>")).otherwise(segments), "template": F.lit("")})
    kept, done = [*raw.columns, "template"], []
    while True:
        ended = F.size("rest") == 0
        done.append(rows.filter(ended).select(*kept))
        live = rows.filter(~ended)
        if live.isEmpty():
            break
        stem = live.groupBy("host", "template").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
        parts = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), False)
        stem = stem.select("host", "template", F.when(parts == 0, F.size("low")).otherwise(parts - 1).cast("int").alias("_same"))
        same = F.col("_same") > 0
        stemmed = live.join(stem, ["host", "template"]).withColumn("template", F.when(same, F.concat("template", F.lit("/"), F.array_join(F.slice("rest", F.lit(1), F.col("_same")), "/"))).otherwise(F.col("template")))
        stemmed = store.written(stemmed.withColumn("rest", F.slice("rest", F.col("_same") + 1, F.size("rest"))).drop("_same"), "stem", few=True)
        rows = store.written(_branched(stemmed).select(*kept, "rest"), "level", few=True)
        store.drop(stemmed)
    out = done[0]
    for table in done[1:]:
        out = out.unionByName(table)
    return out


def _branched(rows: DataFrame) -> DataFrame:
    """Rows (host, template, rest) with the first of the rest's segments as a step of their templates."""
    rows = rows.withColumn("here", F.get("rest", F.lit(0)))
    kids = rows.filter(F.col("here").isNotNull()).groupBy("host", "template", "here").agg(*(F.sum(c).alias(c) for c in ("urls", "seen", "good")))
    kids = kids.withColumn("kind", F.when(F.col("seen") == 0, "*new").when(F.col("good") / F.col("seen") < REJECT, "*low").otherwise("*"))
    node = kids.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("urls").alias("all_urls"), F.max("urls").alias("most_urls"), F.sum("seen").alias("node_seen"), F.sum("good").alias("node_good"))
    side = kids.groupBy("host", "template", "kind").agg(F.count("*").alias("alike"), F.sum("seen").alias("all_seen"), F.sum("good").alias("all_good"))
    variable = (F.col("children") > CHILDREN) & (F.col("most_urls") * SHARE < F.col("all_urls"))
    pool = lambda c: F.when(variable, F.col(f"node_{c}")).otherwise(F.col(f"all_{c}"))
    share = (pool("good") + 1) / (pool("seen") + 2)
    off = F.abs(F.col("good") / F.nullif(F.col("seen"), F.lit(0)) - share)
    similar = (F.col("seen") == 0) | (off * off * F.col("seen") <= Z * Z * share * (1 - share))
    merged = (variable | (F.col("alike") > 1)) & similar
    name = F.when(merged & variable, F.lit("*")).when(merged, F.col("kind")).otherwise(F.col("here"))
    step = kids.join(node, ["host", "template"]).join(side, ["host", "template", "kind"]).select("host", "template", "here", name.alias("step"))
    moved = rows.join(step, ["host", "template", "here"], "left")
    moved = moved.withColumn("template", F.when(F.col("step").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "step")))
    return moved.withColumn("rest", F.slice("rest", 2, F.greatest(F.size("rest"), F.lit(1)))).drop("here", "step")


def verdicts(tree: DataFrame) -> DataFrame:
    """host, raw, template, purity and verdict of every raw template."""
    whole = tree.agg(F.sum("seen").alias("w_seen"), F.sum("good").alias("w_good"))
    host = tree.groupBy("host").agg(F.sum("seen").alias("h_seen"), F.sum("good").alias("h_good"))
    leaf = tree.groupBy("host", "template").agg(F.sum("seen").alias("t_seen"), F.sum("good").alias("t_good"))
    base = F.when(F.col("w_seen") > 0, F.col("w_good") / F.nullif(F.col("w_seen"), F.lit(0))).otherwise(1.0)
    at_host = (F.col("h_good") + SMOOTH * base) / (F.col("h_seen") + SMOOTH)
    purity = (F.col("t_good") + SMOOTH * at_host) / (F.col("t_seen") + SMOOTH)
    rows = tree.join(leaf, ["host", "template"]).join(host, "host").join(F.broadcast(whole))
    return rows.select("host", "raw", "template", purity.alias("purity"), F.when(purity < REJECT, "block").otherwise("allow").alias("judged"))


def judge(pages: DataFrame, labels: DataFrame | None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page."""
    raw = store.written(templates(pages, labels), "templates", few=True)
    found = store.written(verdicts(generalise(raw)), "verdicts", few=True)
    store.drop(raw)
    size = found.agg(F.sum(64 + F.octet_length("host") + F.octet_length("raw") + F.octet_length("template"))).first()[0] or 0
    few = size <= BROADCAST_BYTES
    host, path = host_of(), path_of()
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"raw": raw_template(F.col("path")), "rule": rule, "action": action})
    side = F.broadcast(found) if few else found
    joined = rows.join(side, ["host", "raw"], "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("action", "judged", F.lit("allow")).alias("verdict"), "template", "purity")
