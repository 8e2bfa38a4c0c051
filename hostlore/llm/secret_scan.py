"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

1. Each text is matched once. Gaps and matches alternate, so the lengths of both are all that positions need; texts go no
   further, and values only as SHA-256 digests with what their look says.
2. Digests are counted by distinct repositories and owners. A value that several owners have is a widely copied example;
   one that a single owner has, and that looks like a credential, is live-looking.
3. Every span gets the verdict of its value. The base kinds stay in any case; *opaque* strings, which no keyword or prefix
   gives away, become spans only where they are live-looking and outside of the base spans.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlore.llm.common import free_name, join_weighted, table, written

#: Kinds in the order that spans of equal start take; the group of the value, and the least length of it.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # of a run too short no other part matches, so the least length can be in the pattern
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "opaque": (r"[A-Za-z0-9_-]{24,}", 0, 24),
}
BASE = [k for k in KINDS if k != "opaque"]
LONGEST_OPAQUE = 200
#: A value looks live with so many characters, so many different ones, a digit, and none of these words.
LEAST_CHARS, LEAST_DIFFERENT = 16, 10
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your_|test|xxxx|0000000|1234567"
#: Owners from which on a value is a copied example.
EXAMPLE_OWNERS = 3


def live_look(value: Column) -> Column:
    different = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= LEAST_CHARS) & (different >= LEAST_DIFFERENT) & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDER)


def may_match(text: Column) -> dict[str, Column]:
    """For each kind, whether a text can have matches, by one regular expression over all texts and searches for words."""
    lowered = F.lower(text)
    words = [F.contains(lowered, F.lit(w)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")]
    long_run = text.rlike(KINDS["opaque"][0])  # each run of hexadecimal digits is such a run too
    return {"assign": reduce(or_, words), "access": F.contains(text, F.lit("AKIA")), "opaque": long_run}


def matches(text: Column, kind: str, may: Column) -> Column:
    """The matches of a kind in order: what lies before each, its length, and its value."""
    pattern, group, _ = KINDS[kind]
    some = lambda x: F.when(may, x).otherwise(F.array().cast("array<string>"))
    gaps, hits = some(F.split(text, pattern, -1)), some(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    values = some(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else hits
    lengths = lambda x, name: F.transform(x, lambda s: F.length(s)).alias(name)
    looks = F.transform(
        values,
        lambda v: F.struct(
            F.sha2(v, 256).alias("digest"),
            F.length(v).alias("size"),
            live_look(v).alias("live_look"),
            (v.rlike("[a-z]") & v.rlike("[A-Z]")).alias("mixed"),
        ),
    ).alias("value")
    zipped = F.arrays_zip(lengths(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), "gap"), lengths(hits, "length"), looks)
    number = list(KINDS).index(kind)
    return F.transform(
        zipped, lambda m, i: F.struct(F.lit(number).alias("kind"), i.alias("at"), m["gap"].alias("gap"), m["length"].alias("length"), m["value"].alias("value"))
    )


def scanned(docs: DataFrame, owner: str, repository: list[str]) -> DataFrame:
    """(row, doc_id, owner, repository, found): one row for each document, with all its matches; written, without texts."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository))).alias("repository"),
        text,
    )
    rows = rows.select("*", *(may.alias(f"may_{k}") for k, may in may_match(F.col("text")).items()))
    may = {k: F.col("may_opaque" if k == "hex" else f"may_{k}") for k in KINDS}
    found = F.when(reduce(or_, may.values()), F.concat(*(matches(F.col("text"), k, may[k]) for k in KINDS)))
    none = F.array().cast(rows.select(found.alias("f")).schema["f"].dataType)
    return written(rows.select("row", "doc_id", "owner", "repository", F.coalesce(found, none).alias("found")), "secret-matches")


def candidates(found: DataFrame) -> DataFrame:
    """Matches with their positions, without those too short and without opaque strings that meet a base span."""
    rows = found.where(F.size("found") > 0).select("row", "owner", "repository", F.inline("found"))
    so_far = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("row", "owner", "repository", "kind", (so_far - F.col("length")).alias("start"), so_far.alias("end"), "value.*")
    opaque = F.col("kind") == list(KINDS).index("opaque")
    least = F.coalesce(*(F.when(F.col("kind") == i, F.lit(n)) for i, (_, _, n) in enumerate(KINDS.values())))
    fits = F.when(opaque, F.col("mixed") & F.col("live_look") & (F.col("size") <= LONGEST_OPAQUE)).otherwise(F.col("size") >= least)
    rows = rows.where(fits)
    by_start = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    from_end = Window.partitionBy("row").orderBy(F.desc("start"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(
        {"reached": F.max(F.when(~opaque, F.col("end"))).over(by_start), "following": F.min(F.when(~opaque, F.col("start"))).over(from_end)}
    )
    clear = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.col("following").isNull() | (F.col("following") >= F.col("end")))
    return written(rows.where(~opaque | clear).drop("reached", "following", "mixed", "size"), "secret-candidates")


def ownership(values: DataFrame) -> DataFrame:
    """(digest, n, repositories, owners) of (digest, owner, repository): each level is summed before it is shuffled."""
    each = values.groupBy("digest", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = each.groupBy("digest", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    return by_owner.groupBy("digest").agg(F.sum("n").alias("n"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def find_secrets(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, the owner's and the repository's columns) its spans, by start and kind.

    ``spans``: array of (start, kind, end, verdict, owners, repositories), positions in code points, ends exclusive. The
    verdict is ``copied`` where ``example_owners`` or more have the value, ``live`` where one owner has it and it looks
    like a credential, ``placeholder`` where one has it and it doesn't, and ``shared`` between. Null and empty texts have
    no spans; null owners and repositories are empty ones; repeated rows each get their row, and count as one owner's;
    a null doc_id stays null; an empty table has no rows. Other columns are not read.
    """
    found = scanned(docs, owner, list(repository))
    hits = candidates(found)
    spread = written(ownership(hits.select("digest", "owner", "repository")), "secret-owners")
    judged = join_weighted(hits.drop("owner", "repository"), spread.withColumn("w", F.col("n")), "digest", "w")
    verdict = (
        F.when(F.col("owners") >= example_owners, "copied").when(F.col("owners") > 1, "shared").when(F.col("live_look"), "live").otherwise("placeholder")
    )
    opaque = F.col("kind") == list(KINDS).index("opaque")
    spans = judged.withColumn("verdict", verdict).where(~opaque | (F.col("verdict") == "live"))
    lists = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "verdict", "owners", "repositories"))).alias("spans"))
    with_any = found.where(F.size("found") > 0).select("row", "doc_id").join(lists, "row", "left").drop("row")
    none = F.array().cast(lists.schema["spans"].dataType)
    with_any = with_any.withColumn("spans", F.coalesce("spans", none))
    return with_any.unionByName(found.where(F.size("found") == 0).select("doc_id", none.alias("spans")))


def masked(docs: DataFrame, verdicts: tuple[str, ...] = ("live", "shared"), **options: object) -> DataFrame:
    """``docs`` with the columns they have, and in ``text`` each span of one of the ``verdicts`` replaced by <kind>.

    Rows are told apart by doc_id, which should be unique. Where spans overlap, the first is replaced and the rest of the
    others goes with it. Null texts stay null.
    """
    spans, at = free_name(docs, "spans"), free_name(docs, "pieces")
    wanted = find_secrets(docs, **options).select("doc_id", F.filter("spans", lambda s: s["verdict"].isin(*verdicts)).alias(spans)).where(F.size(spans) > 0)
    names = F.array(*(F.lit(k) for k in KINDS))
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substr(F.col("text"), (acc["done"] + 1).cast("int"), F.greatest(s["start"] - acc["done"], F.lit(0)).cast("int"))
        sign = F.when(s["start"] >= acc["done"], F.concat(F.lit("<"), F.element_at(names, s["kind"] + 1), F.lit(">"))).otherwise("")
        return F.struct(F.concat(acc["text"], kept, sign).alias("text"), F.greatest(acc["done"], s["end"]).alias("done"))

    rows = docs.join(wanted, "doc_id", "left").withColumn(at, F.aggregate(spans, start, step))
    new = F.concat(F.col(at)["text"], F.substr(F.col("text"), (F.col(at)["done"] + 1).cast("int")))
    return rows.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(new)).select(docs.columns)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_secrets(table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(k) for k in KINDS))
    words = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda field, value: F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")
    opaque = list(KINDS).index("opaque")
    return rows.select(
        "doc_id",
        *(count("kind", i).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(words(F.filter("spans", lambda s: s["kind"] != opaque)), 256).alias("base_sha256"),
        words(F.col("spans")).alias("spans"),
        *(count("verdict", v).alias(f"n_{v}") for v in ("live", "copied")),
        F.array_join(F.transform("spans", lambda s: s["verdict"]), ",").alias("verdicts"),
    )


def found_sql(kind: str) -> str:
    """Spans of a kind as DuckDB SQL: each begins after the gaps up to it and the matches before it."""
    pattern, group, least = KINDS[kind]
    p, number = pattern.replace("'", "''"), list(KINDS).index(kind)
    return f"""SELECT r, owner, repo, {number} AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) +
    coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s, length(hits[i]) AS l, vals[i] AS v
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT r, owner, repo, regexp_split_to_array(text, '{p}') AS gaps,
    regexp_extract_all(text, '{p}', 0) AS hits, regexp_extract_all(text, '{p}', {group}) AS vals FROM d)) WHERE length(vals[i]) >= {least}"""


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner,
    coalesce(source, '') || chr(0) || coalesce(lang, '') AS repo
  FROM documents),
f AS ({" UNION ALL ".join(found_sql(k) for k in KINDS)}),
c AS (
  SELECT *, s + l AS e, length(v) >= {LEAST_CHARS} AND len(list_distinct(string_split(v, ''))) >= {LEAST_DIFFERENT} AND regexp_matches(v, '[0-9]')
    AND NOT regexp_matches(v, '{PLACEHOLDER}') AS look FROM f),
fit AS (
  SELECT * FROM c WHERE kind < 3 OR (look AND length(v) <= {LONGEST_OPAQUE} AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM c b WHERE b.r = c.r AND b.kind < 3 AND b.s < c.e AND b.e > c.s))),
o AS (SELECT v, count(DISTINCT owner) AS owners FROM fit GROUP BY v),
j AS (
  SELECT fit.*, CASE WHEN owners >= {EXAMPLE_OWNERS} THEN 'copied' WHEN owners > 1 THEN 'shared' WHEN look THEN 'live' ELSE 'placeholder' END AS verdict,
    CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'opaque' END || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR) AS w
  FROM fit JOIN o ON fit.v = o.v),
a AS (
  SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg(w, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(w, ',' ORDER BY s, kind) AS spans,
    count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'copied') AS n_copied,
    string_agg(verdict, ',' ORDER BY s, kind) AS verdicts
  FROM j WHERE kind < 3 OR verdict = 'live' GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(verdicts, '') AS verdicts
FROM d LEFT JOIN a USING (r)
"""
