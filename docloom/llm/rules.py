"""Quality rules whose limits follow the corpus: quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, hidden, if_small, reliable

#: Each feature's damping, added to the whole of which it is a share so that chance in a short text is no sign, and the least spread that counts.
FEATURES = {"upper": (20, 0.02), "symbol": (20, 0.02), "repeat": (5, 0.02), "same_line": (3, 0.06)}
#: Size of a sketch: ranks are right within about 0.3 %, and exact up to so many values.
SKETCH = 1024
#: Quantiles read from a sketch.
QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95)
#: A limit lies this many spreads over the highest quantile that is trusted.
REACH = 3.0
#: Documents at which a group's own limits weigh as much as its language's.
SHRINK = 100.0


def features(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Damped share of each feature.

    upper: capital letters; symbol: characters other than letters, digits, white
    space, comma and full stop; repeat: words equal to the one before; same_line:
    lines with text that occurred before.  The first two are shares of characters.
    """
    n = F.length(text)
    counts = {
        "upper": (F.length(F.regexp_replace(text, "[^A-ZÀ-ÖØ-Þ]+", "")), n),
        "symbol": (F.length(F.regexp_replace(text, "[A-Za-zÀ-ɏ0-9 \\t\\r\\n.,]+", "")), n),
        "repeat": (F.size(F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: a == b), lambda same: same)), F.size(words)),
        "same_line": (F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
    }
    return {k: count.cast("double") / (whole + F.lit(FEATURES[k][0])).cast("double") for k, (count, whole) in counts.items()}


def with_features(docs: DataFrame, prefix: str) -> DataFrame:
    """``docs`` and {prefix}lang, {prefix}source (never null) and each feature."""
    text, words, lines = (prefix + x for x in ("text", "words", "lines"))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    out = docs.withColumns({text: F.coalesce("text", F.lit("")), prefix + "lang": key("lang"), prefix + "source": key("source")})
    out = out.withColumns({words: F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), 0), lines: F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")})
    return out.withColumns({prefix + k: c for k, c in features(F.col(text), F.col(words), F.col(lines)).items()}).drop(text, words, lines)


def trusted_limit(q: list[Column], least: float, reach: float) -> Column:
    """The limit that quantiles give: from the median on, the next one is trusted if it lies within the limit that the last one gives.

    A fault that a share of the group has makes the quantiles jump, so that
    those above the jump, which are of faulty documents, don't raise the limit.
    """
    over = lambda x: x + F.lit(reach) * F.greatest(x - q[0], F.lit(least))
    last = q[-1]
    for below, above in reversed(list(zip(q[1:-1], q[2:], strict=True))):
        last = F.when(above <= over(below), last).otherwise(below)
    return over(last)


def sketches(rows: DataFrame, prefix: str) -> DataFrame:
    """(lang, source, n, a KLL sketch of each feature): partial sketches are merged on the way to a group's."""
    lang, source = prefix + "lang", prefix + "source"
    return rows.groupBy(lang, source).agg(F.count("*").alias(prefix + "n"), *(F.kll_sketch_agg_double(prefix + k, SKETCH).alias(prefix + k) for k in FEATURES))


def limits(rows: DataFrame, prefix: str, reach: float = REACH, shrink: float = SHRINK) -> DataFrame:
    """One row per (lang, source): the largest value allowed for each feature.

    A group's sketches are merged into its language's.  A group's limit is the
    mean of its own and its language's, weighted n : shrink.
    """
    lang, source, n = prefix + "lang", prefix + "source", prefix + "n"
    own = reliable(sketches(rows, prefix))
    wide = own.groupBy(lang).agg(*(F.kll_merge_agg_double(prefix + k, SKETCH).alias(f"{prefix}{k}_wide") for k in FEATURES))
    both = own.join(wide, lang)

    def limit(sketch: str, k: str) -> Column:
        return trusted_limit([F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in QUANTILES], FEATURES[k][1], reach)

    mean = {k: (limit(prefix + k, k) * F.col(n) + limit(f"{prefix}{k}_wide", k) * shrink) / (F.col(n) + shrink) for k in FEATURES}
    return both.select(lang, source, *(c.alias(f"{prefix}{k}_limit") for k, c in mean.items()))


def within(prefix: str) -> Column:
    ok = F.lit(True)
    for k in FEATURES:
        ok = ok & (F.col(prefix + k) <= F.col(f"{prefix}{k}_limit"))
    return ok


def filter_quality(docs: DataFrame, reach: float = REACH, shrink: float = SHRINK) -> DataFrame:
    """The documents within the limits of their language and source, with all their columns.

    Limits come from every document, by mergeable KLL quantile sketches, and are
    joined back, one row per group, broadcast if their number allows.  A document
    goes if any feature lies over its limit.

    Defined cases: null languages and sources are groups of their own; a null or
    empty text has 0 for all features and stays; repeated rows count each
    and stay or go together; a group of a few documents has nearly its
    language's limits; groups of more than SKETCH documents have limits from
    quantiles whose rank is right within about 0.3 %, so that documents just at a
    limit may fall either way; a fault that half of a group or more has lifts
    its limit; an empty table gives no rows.
    """
    (prefix,) = hidden(docs, "rule_")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    rows = with_features(docs, prefix)
    keys = [prefix + "lang", prefix + "source"]
    lim = limits(reliable(rows.select(*keys, *(prefix + k for k in FEATURES))), prefix, reach, shrink)
    lim = if_small(reliable(lim.withColumnsRenamed({k: k + "_l" for k in keys})))
    return rows.join(lim, (F.col(keys[0]) == F.col(keys[0] + "_l")) & (F.col(keys[1]) == F.col(keys[1] + "_l"))).where(within(prefix)).select(*docs.columns)


def kept_ids(docs: DataFrame, reach: float = REACH, shrink: float = SHRINK) -> DataFrame:
    """(doc_id, lang, source, features rounded) of what filter_quality keeps; texts are read once."""
    rows = reliable(with_features(docs.select("doc_id", "lang", "source", "text"), "r_").drop("text"))
    lim = if_small(reliable(limits(rows, "r_", reach, shrink).withColumnsRenamed({"r_lang": "l_lang", "r_source": "l_source"})))
    kept = rows.join(lim, (F.col("r_lang") == F.col("l_lang")) & (F.col("r_source") == F.col("l_source"))).where(within("r_"))
    return kept.select("doc_id", "lang", "source", *(F.round("r_" + k, 6).alias(k) for k in FEATURES))


def _share(k: str, count: str, whole: str) -> str:
    return f"({count})::DOUBLE / ({whole} + {FEATURES[k][0]})::DOUBLE AS {k}"


def _limit(keys: str) -> str:
    over = lambda x: f"({x} + {REACH}::DOUBLE * greatest({x} - q[1], least))"
    last = f"q[{len(QUANTILES)}]"
    for i in range(len(QUANTILES) - 1, 1, -1):
        last = f"CASE WHEN q[{i + 1}] <= {over(f'q[{i}]')} THEN {last} ELSE q[{i}] END"
    at = ", ".join(f"min(v) FILTER (WHERE rn >= {q}::DOUBLE * n)" for q in QUANTILES)
    return f"""SELECT {keys}, feature, n, {over("last")} AS lim FROM (SELECT *, {last} AS last FROM (SELECT {keys}, feature, max(n) AS n, max(least) AS least, [{at}] AS q FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys}, feature ORDER BY v) AS rn, count(*) OVER (PARTITION BY {keys}, feature) AS n FROM x) GROUP BY {keys}, feature))"""


SQL = (
    r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, coalesce('=' || lang, 'null') AS l, coalesce('=' || source, 'null') AS s FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ \t\n\r]+') AS words, list_filter(string_split(text, chr(10)), lambda z: trim(z) <> '') AS lines,
  length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_upper, length(regexp_replace(text, '[A-Za-zÀ-ɏ0-9 \t\r\n.,]+', '', 'g')) AS n_symbol FROM d),
b AS (SELECT doc_id, lang, source, l, s, """
    + _share("upper", "n_upper", "length(text)")
    + ", "
    + _share("symbol", "n_symbol", "length(text)")
    + ", "
    + _share("repeat", "len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))", "len(words)")
    + ", "
    + _share("same_line", "len(lines) - len(list_distinct(lines))", "len(lines)")
    + """ FROM w),
x AS ("""
    + " UNION ALL ".join(f"SELECT l, s, '{k}' AS feature, {k} AS v, {least}::DOUBLE AS least FROM b" for k, (_, least) in FEATURES.items())
    + """),
own AS ("""
    + _limit("l, s")
    + "), wide AS ("
    + _limit("l")
    + f"""), lim AS (SELECT own.l, own.s, own.feature, (own.lim * own.n + wide.lim * {SHRINK}::DOUBLE) / (own.n + {SHRINK}::DOUBLE) AS lim FROM own JOIN wide ON own.l = wide.l AND own.feature = wide.feature)
SELECT doc_id, lang, source, """
    + ", ".join(f"round({k}, 6) AS {k}" for k in FEATURES)
    + """ FROM b WHERE NOT EXISTS (
  SELECT 1 FROM lim WHERE lim.l = b.l AND lim.s = b.s AND CASE feature WHEN 'upper' THEN upper WHEN 'symbol' THEN symbol WHEN 'repeat' THEN repeat ELSE same_line END > lim.lim)
"""
)
