"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Four patterns give candidates with their places. Of each candidate only the SHA-256 of
its value is carried on. The hashes are aggregated over the corpus by distinct
repository and owner: a value that many owners or very many repositories hold is a
copied example, one that stays with few looks live. The three base kinds are always reported; of the
fourth kind, opaque tokens, only those that look live are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgrove.storage import Scratch, small


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: In the runs below the shorter ones fail as a whole, so the least length can stand in the pattern.
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
OPAQUE = r"(gh[pousr]_|sk_live_|xox[abprs]-|glpat-|AIza|eyJ)[A-Za-z0-9_.-]{16,}|[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "opaque")
#: Values held by this many owners, or in this many repositories of any owners, or more are copied examples.
COMMON_OWNERS, COMMON_REPOS = 3, 25


def _candidates(text: Column, kind: int) -> Column:
    """Array of (kind, i, gap, len, value, fits) in text order; gap: characters since the last match."""
    pattern = F.lit((ASSIGN, ACCESS, HEX, OPAQUE)[kind])
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == 0 else whole
    gaps = F.split(text, (ASSIGN, ACCESS, HEX, OPAQUE)[kind], -1)

    def build(z: Column, i: Column) -> Column:
        v = z["v"]
        if kind == 0:
            fits = F.length(v) >= 8
        elif kind == 3:  # digits, capitals and small letters: random, not a word or a path
            fits = v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
        else:
            fits = F.lit(True)
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(z["g"]).alias("gap"), F.length(z["w"]).alias("len"), F.unhex(F.sha2(v, 256)).alias("value"), fits.alias("fits"))

    found = F.transform(F.arrays_zip(gaps.alias("g"), whole.alias("w"), value.alias("v")), build)
    # most texts end at a search for a character or at the first pattern; null: nothing found
    may = {0: F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), 1: F.contains(text, F.lit("AKIA"))}.get(kind, F.lit(True))
    return F.when(may & F.rlike(text, pattern), F.slice(found, 1, F.size(found) - 1))


def secret_spans(spark: SparkSession, docs: DataFrame, common_owners: int = COMMON_OWNERS, common_repos: int = COMMON_REPOS, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_opaque, n_copied, most_owners, most_repos: one row per input row.

    A null text is empty and has no span; a null repository or owner counts as one of
    the empty name. Rows that repeat keep rows of their own, and their values count
    once a repository and owner. ``n_copied`` counts spans whose value is held by
    ``common_owners`` owners or in ``common_repos`` repositories, or more; ``most_owners``
    and ``most_repos`` are the greatest numbers of either of a value that is held so
    widely, else 0. A repository of one document makes every copy of a text a repository. An empty table gives an empty result; columns
    not named here are not looked at.
    """
    scratch = Scratch(spark, "secrets")
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    found = read.select("id", "repo", "owner", "row", F.explode_outer(F.flatten(F.array_compact(F.array(*[_candidates(F.col("text"), k) for k in range(len(KINDS))])))).alias("x")).select("id", "repo", "owner", "row", "x.*")
    found = scratch.table(found, "found")

    # owners of a value, each counted once; the hot values shrink before they meet
    held = found.where("fits").groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = held.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    owned = by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    common = scratch.table(owned.where((F.col("owners") >= common_owners) | (F.col("repos") >= common_repos)).select(F.col("value").alias("key"), "owners", "repos"), "common")

    # rows without a candidate get a key of their own, so that they don't meet in one task
    keyed = found.withColumn("key", F.coalesce("value", F.col("row").cast("string").cast("binary")))
    judged = keyed.join(small(common), "key", "left").repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = judged.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
    base = F.coalesce(F.col("fits") & (F.col("kind") < 3), F.lit(False))
    live = F.coalesce(F.col("fits") & (F.col("kind") == 3) & F.col("owners").isNull(), F.lit(False))
    place = F.struct((F.col("end") - F.col("len")).alias("start"), F.col("kind").alias("kind"), F.col("end").alias("end"))
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    rows = placed.groupBy("row").agg(
        F.first("id").alias(id_col),
        *[F.count_if(base & (F.col("kind") == k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.collect_list(F.when(base, place)).alias("base"),
        F.collect_list(F.when(base | live, place)).alias("every"),
        F.count_if(live).alias("n_opaque"),
        F.count_if((base | live) & F.col("owners").isNotNull()).alias("n_copied"),
        *[F.coalesce(F.max(F.when(base | live, F.col(c))), F.lit(0)).alias(f"most_{c}") for c in ("owners", "repos")],
    )
    return rows.select(id_col, "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("every")).alias("spans"), "n_opaque", "n_copied", "most_owners", "most_repos")


def _sql_kind(kind: int) -> str:
    pattern = (ASSIGN, ACCESS, HEX, OPAQUE)[kind].replace("'", "''")
    fits = {0: "len(v) >= 8", 3: "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')"}.get(kind, "true")
    return f"""SELECT row, repo, owner, {kind} AS kind, i, len(g[i]) AS gap, len(w[i]) AS len, v[i] AS v FROM (
      SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT row, repo, owner, regexp_extract_all(text, '{pattern}') AS w, regexp_extract_all(text, '{pattern}', {2 * (kind == 0)}) AS v, string_split_regex(text, '{pattern}') AS g FROM d))""", fits


_parts = [_sql_kind(k) for k in range(len(KINDS))]
#: DuckDB SQL for the result over ``documents``.
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(doc_id::VARCHAR, '') AS repo, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
c AS ({' UNION ALL '.join(sql for sql, _ in _parts)}),
f AS (SELECT *, sum(gap + len) OVER (PARTITION BY row, kind ORDER BY i) AS stop, CASE kind {' '.join(f'WHEN {k} THEN {fits}' for k, (_, fits) in enumerate(_parts))} END AS fits FROM c),
o AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (repo, owner)) AS repos FROM f WHERE fits GROUP BY v HAVING count(DISTINCT owner) >= {COMMON_OWNERS} OR count(DISTINCT (repo, owner)) >= {COMMON_REPOS}),
j AS (SELECT row, kind, (stop - len)::BIGINT AS start, stop::BIGINT AS stop, owners, repos, {list(KINDS)}[kind + 1] || ':' || (stop - len)::BIGINT || ':' || stop::BIGINT AS span FROM f LEFT JOIN o USING (v) WHERE fits AND (kind < 3 OR owners IS NULL)),
g AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans, count(*) FILTER (kind = 3) AS n_opaque, count(owners) AS n_copied, max(owners) AS most_owners, max(repos) AS most_repos FROM j GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_opaque, 0) AS n_opaque, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN g USING (row)
"""
