"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hidden, if_small, n_words, reliable

#: Shares asked of each source, relative; sources not named get OTHER.
TARGETS: dict[str, float] = {"src0": 2.0}
OTHER = 1.0
SEED = 17
#: Buckets per unit of ln(key): one holds at most about 1/2048 of a source, and only the one at a cut is sorted.
FINENESS = 2048


def quality_weight(text: Column) -> Column:
    """Share of small letters and blanks in the text, at least 0.05: low for shouting, symbols and tables."""
    text = F.coalesce(text, F.lit(""))
    rest = F.length(F.regexp_replace(text, "[a-zß-öø-ÿ ]+", ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - rest / F.greatest(F.length(text), F.lit(1)))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """Efraimidis-Spirakis key, -ln(u)/w, with u in (0, 1) from a hash of id and text: the smallest keys are the sample."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def mixing_plan(docs: DataFrame, targets: Mapping[str, float] = TARGETS, other: float = OTHER, total_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """One row per source: (src, n_docs, tokens, budget, epochs, bucket, cut_key, cut_id).

    A document is in the fractional epoch if its bucket lies before ``bucket``,
    or is that bucket and (key, doc_id) is at most the cut.  Prefix sums run in
    two levels: over the totals of (source, bucket), then over the documents of
    the one bucket in which the source's budget ends.
    """
    shares = [*targets.values(), other]
    if any(not 0 <= float(v) < float("inf") for v in shares) or not any(float(v) for v in shares):
        raise ValueError("shares must be finite, at least 0, and not all 0")
    base = docs.select(
        source_key(F.col("source")).alias("src"),
        F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"),
        n_words(F.col("text")).cast("bigint").alias("tokens"),
        sampling_key(F.col("doc_id"), F.col("text"), quality_weight(F.col("text")), seed).alias("key"),
    ).withColumn("bucket", F.floor(F.log("key") * FINENESS))
    base = reliable(base)
    per_bucket = base.groupBy("src", "bucket").agg(F.sum("tokens").alias("b_tokens"), F.count("*").alias("b_docs"))
    share = F.lit(float(other))
    for name, value in targets.items():
        share = F.when(F.col("src") == F.lit(f"={name}"), F.lit(float(value))).otherwise(share)
    sources = per_bucket.groupBy("src").agg(F.sum("b_tokens").alias("tokens"), F.sum("b_docs").alias("n_docs")).withColumn("share", share)
    whole = sources.agg(F.sum("tokens").alias("all_tokens"), F.sum("share").alias("all_share"))  # one row
    total = F.col("all_tokens") if total_tokens is None else F.lit(int(total_tokens))
    sources = sources.crossJoin(F.broadcast(whole)).withColumn("budget", F.floor(total * F.col("share") / F.when(F.col("all_share") > 0, F.col("all_share")).otherwise(1.0)).cast("bigint"))
    sources = sources.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("bigint"))
    sources = sources.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).select("src", "n_docs", "tokens", "budget", "epochs", "rest")
    running = Window.partitionBy("src").orderBy("bucket")
    cut = (
        per_bucket.withColumn("upto", F.sum("b_tokens").over(running))
        .join(sources.select("src", "rest"), "src")
        .where((F.col("upto") > F.col("rest")))
        .groupBy("src")
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("b_tokens")).alias("before"), "rest")).alias("c"))
        .select("src", "c.*")
    )
    inside = Window.partitionBy("src").orderBy("key", "id")  # rows equal in both count as one: the default frame has the peers
    last = (
        base.join(cut, ["src", "bucket"])
        .withColumn("upto", F.col("before") + F.sum("tokens").over(inside))
        .where(F.col("upto") <= F.col("rest"))
        .groupBy("src")
        .agg(F.max(F.struct("key", "id")).alias("m"))
        .select("src", F.col("m.key").alias("cut_key"), F.col("m.id").alias("cut_id"))
    )
    return sources.join(cut.select("src", "bucket"), "src", "left").join(last, "src", "left").drop("rest")


def mix_sources(docs: DataFrame, targets: Mapping[str, float] = TARGETS, other: float = OTHER, total_tokens: int | None = None, seed: int = SEED, copies: str = "copies") -> DataFrame:
    """Adds ``copies``: how often each document is drawn to meet its source's token budget; documents drawn 0 times go.

    A source's budget is its share of ``total_tokens`` (the corpus's own number
    of words if None).  Complete epochs come first: every document of the
    source is drawn floor(budget / tokens of the source) times.  What remains is
    filled by Efraimidis-Spirakis sampling: documents in order of -ln(u)/w, u
    hashed from doc_id and seed, w the text's quality weight, as long as their
    prefix sum of words is within the budget.

    Texts are never shuffled: a narrow pass finds each source's cut, and a
    document is compared with the cut where it is read.  The plan has one row
    per source and is broadcast if their number allows, so that no task has to
    take a frequent source whole.

    Defined cases: a null source is a source of its own; a null doc_id ranks
    before all others of its key; rows equal in doc_id and text are drawn or left
    together; a source whose share is 0 has a budget of 0, and so have all if no
    source of the table has a share; shares that are negative, or all 0, raise
    ValueError; a null or empty text has no words, weight 1 - 0 = 1, and fits any
    rest; a source without words is drawn once; an empty table gives no rows.
    All columns of ``docs`` are kept; ``copies`` must not be one of them, else
    ValueError.
    """
    if copies.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {copies} already")
    plan = mixing_plan(docs, targets, other, total_tokens, seed)
    src, key, bucket = hidden(docs, "mix_src", "mix_key", "mix_bucket")
    p = {c: f"{src}_{c}" for c in ("src", "epochs", "bucket", "cut_key", "cut_id")}
    plan = if_small(reliable(plan.select(*(F.col(c).alias(n) for c, n in p.items()))))
    rows = docs.withColumns({src: source_key(F.col("source")), key: sampling_key(F.col("doc_id"), F.col("text"), quality_weight(F.col("text")), seed)})
    rows = rows.withColumn(bucket, F.floor(F.log(key) * FINENESS))
    ident = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    at_cut = (F.col(key) < F.col(p["cut_key"])) | ((F.col(key) == F.col(p["cut_key"])) & (ident <= F.col(p["cut_id"])))
    drawn = F.col(p["bucket"]).isNull() | (F.col(bucket) < F.col(p["bucket"])) | ((F.col(bucket) == F.col(p["bucket"])) & F.coalesce(at_cut, F.lit(False)))
    rows = rows.join(plan, F.col(src) == F.col(p["src"]))
    rows = rows.withColumn(copies, F.col(p["epochs"]) + F.when(drawn, 1).otherwise(0))
    return rows.where(F.col(copies) > 0).select(*(docs[c] for c in docs.columns), F.col(copies))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each as often as it is drawn."""
    (copies,) = hidden(docs, "mix_copies")
    drawn = mix_sources(docs, copies=copies, **how)
    (each,) = hidden(drawn, "mix_each")
    return drawn.withColumn(each, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))).select(*docs.columns)


def mixed_ids(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents drawn."""
    drawn = mix_sources(docs.select("doc_id", "source", "text"), **how)
    return drawn.select("doc_id", "source", n_words(F.col("text")).cast("bigint").alias("n_tokens"), F.col("copies").cast("bigint"))


KEYED_SQL = r"""
  SELECT *, -ln((CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / greatest(0.05::DOUBLE, 1.0::DOUBLE - length(regexp_replace(coalesce(text, ''), '[a-zß-öø-ÿ ]+', '', 'g'))::DOUBLE / greatest(length(coalesce(text, '')), 1)) AS mkey,
    coalesce('=' || source, 'null') AS src,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS BIGINT) AS n_tokens,
    CASE WHEN source = 'src0' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS share
  FROM {docs}
"""

MIX_CTES = (
    "keyed AS ("
    + KEYED_SQL
    + """), srcs AS (
  SELECT src, sum(n_tokens) AS tokens, min(share) AS share FROM keyed GROUP BY src
), plan AS (
  SELECT src, tokens, CAST(floor((SELECT sum(tokens) FROM srcs)::DOUBLE * share / (SELECT sum(share) FROM srcs)) AS BIGINT) AS budget FROM srcs
), drawn AS (
  SELECT k.*, CASE WHEN p.tokens > 0 THEN CAST(p.budget // greatest(p.tokens, 1) AS BIGINT) ELSE 0 END AS epochs, p.budget, p.tokens,
    sum(n_tokens) OVER (PARTITION BY k.src ORDER BY mkey, coalesce(doc_id, -9223372036854775808)) AS upto
  FROM keyed k JOIN plan p ON k.src = p.src
)
"""
)

SQL = (
    "WITH "
    + MIX_CTES.replace("{docs}", "documents")
    + """
SELECT doc_id, source, n_tokens, copies FROM (
  SELECT *, CAST(epochs + CASE WHEN upto <= budget - epochs * tokens THEN 1 ELSE 0 END AS BIGINT) AS copies FROM drawn) WHERE copies > 0
"""
)
