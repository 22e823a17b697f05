"""Licence scan: MinHash bands over overlapping text windows, verified by exact containment.

A text is a list of lower-case words (runs of a-z and 0-9) and of their
``SHINGLE``-word shingles. A template of S shingles is looked for in windows of W
shingles every W/4, W being the power of two with S <= 3 W / 4: each run of S shingles lies whole in some window. A window that
holds 0.8 of the template has a Jaccard similarity to it of 0.28 or more,
so with ``BANDS`` = 32 bands of one row each the chance to miss it is below 0.72^32, 3 in 100,000.

Windows without any shingle of any template can't match; they are left out before
signatures are made, by one test of each shingle's hash. Windows
that share a band with a template are verified on the words themselves. All of it is built-in functions; the templates
are a fixed list, which is all that is broadcast. Long texts are scanned in overlapping parts, which bounds a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_templates import TEMPLATES

SHINGLE = 5
BANDS = 32
THRESHOLD = 0.8
#: Words of a part of a text; a multiple of every stride in use, so that windows start alike in all parts.
PART = 4096


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def _n_shingles(words: Column) -> Column:
    return F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))


def _shingles(words: Column, made) -> Column:
    """``made(five words)`` at each position of ``words``."""
    n = _n_shingles(words)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: made(*[F.get(words, i + k) for k in range(SHINGLE)]))


def _parts(words: Column, overlap: int) -> Column:
    """(base, words) of the parts of ``PART`` words that a long text is scanned in, each with the ``overlap`` words after it."""
    bases = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(PART))
    return F.transform(bases, lambda b: F.struct(b.alias("base"), F.slice(words, b + 1, PART + overlap).alias("words")))


def _window(n: Column) -> Column:
    """The least power of two, from 2 on, with n <= 3/4 of it."""
    return F.greatest(F.lit(2), F.pow(F.lit(2.0), F.ceil(F.log2(n * 4 / 3.0) - 1e-9)).cast("int"))


def _signature(hashes: Column) -> Column:
    least = lambda band: F.array_min(F.transform(hashes, lambda h: F.xxhash64(F.lit(band), h)))
    return F.array(*[least(band) for band in range(BANDS)])


def _once(value: Column) -> Column:
    """``value``, computed once a row: filters and lambdas above don't pull its expression into themselves."""
    return F.explode(F.array(value))


def _windows_over(hits: Column, width: int) -> Column:
    """(width, start) of the windows of one width that hold a position of ``hits``."""
    stride = max(1, width // 4)
    covering = F.flatten(F.transform(hits, lambda p: F.array(*[(F.floor(p / stride).cast("int") - k) * stride for k in range(width // stride)])))
    own = F.filter(F.array_distinct(covering), lambda s: s >= 0)
    return F.transform(own, lambda s: F.struct(F.lit(width).alias("width"), s.alias("start")))


def template_table(spark, templates: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(template_id, license, shingles, n_shingles, width, hashes, bands); templates of fewer than five words give none."""
    raw = spark.createDataFrame([tuple(x) for x in templates], "template_id string, license string, body string")
    words = raw.withColumn("w", words_of(F.col("body")))
    made = words.select(
        "template_id", "license",
        F.array_distinct(_shingles(F.col("w"), lambda *x: F.concat_ws(" ", *x))).alias("shingles"),
        F.array_distinct(_shingles(F.col("w"), lambda *x: F.xxhash64(*x))).alias("hashes"),
    )
    made = made.filter(F.size("shingles") > 0).withColumn("n_shingles", F.size("shingles"))
    return made.withColumn("width", _window(F.col("n_shingles"))).withColumn("bands", _signature(F.col("hashes")))


def license_matches(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each id and template found: (id, template_id, license, n_shingles, containment, start_word, n_words).

    ``containment`` is the largest share of the template's distinct shingles in a window; ``start_word`` and ``n_words`` give the first such window.
    Null, empty and short texts match nothing; rows that repeat an id are one document; an empty table or list gives no rows.
    Whole texts are scanned.
    """
    spark = docs.sparkSession
    fixed = template_table(spark, templates).collect()  # as many rows as templates
    widths = sorted({r["width"] for r in fixed})
    known = sorted({h for r in fixed for h in r["hashes"]})
    shown = F.broadcast(
        spark.createDataFrame(
            [(r["template_id"], r["license"], r["shingles"], r["n_shingles"], r["width"], b, v) for r in fixed for b, v in enumerate(r["bands"])],
            "template_id string, license string, shingles array<string>, n_shingles int, width int, band int, value long",
        )
    )
    rows = docs.select(F.col(id_col).alias("_id"), _once(words_of(F.col(text_col))).alias("words"))
    rows = rows.select("_id", F.explode(_parts(F.col("words"), max(widths, default=0) + SHINGLE)).alias("p")).select("_id", "p.base", "p.words")
    rows = rows.select("_id", "base", "words", _once(_shingles(F.col("words"), lambda *x: F.xxhash64(*x))).alias("hashes"))
    rows = rows.filter(F.arrays_overlap("hashes", F.array(*[F.lit(h) for h in known]).cast("array<long>")))
    hits = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: F.get("hashes", i).isin(known))
    starts = [_windows_over(F.col("hits"), width) for width in widths]
    windows = rows.select("_id", "base", "words", "hashes", _once(hits).alias("hits")).select("_id", "base", "words", "hashes", _once(F.filter(F.concat(*starts), lambda w: w["start"] < PART)).alias("windows")) if widths else rows.withColumn("windows", F.lit(None).cast("array<struct<width:int,start:int>>"))
    cut_out = F.transform(
        "windows",
        lambda w: F.struct(w["width"].alias("width"), (F.col("base") + w["start"]).alias("start"), F.slice("hashes", w["start"] + 1, w["width"]).alias("hashes"), F.slice("words", w["start"] + 1, w["width"] + (SHINGLE - 1)).alias("words")),
    )
    windows = windows.select("_id", F.explode(cut_out).alias("w")).select("_id", "w.*")
    bands = F.transform(_signature(F.col("hashes")), lambda v, i: F.struct(i.alias("band"), v.alias("value")))
    values = sorted({v for r in fixed for v in r["bands"]})
    # Only bands that some template has are rows: the words aren't copied for the others.
    banded = windows.select("_id", "width", "start", "words", F.explode(F.filter(bands, lambda b: b["value"].isin(values))).alias("b")).select("_id", "width", "start", "words", "b.*")
    met = banded.join(shown, ["width", "band", "value"])
    met = met.groupBy("_id", "width", "start", "template_id").agg(*[F.first(c).alias(c) for c in ("words", "license", "shingles", "n_shingles")])
    held = F.size(F.array_intersect(_shingles(F.col("words"), lambda *x: F.concat_ws(" ", *x)), F.col("shingles")))
    verified = met.withColumn("containment", held / F.col("n_shingles")).filter(F.col("containment") >= threshold)
    best = F.max(F.struct("containment", (-F.col("start")).alias("back"), F.size("words").alias("n_words"))).alias("best")
    found = verified.groupBy("_id", "template_id", "license", "n_shingles").agg(best)
    return found.select(
        F.col("_id").alias(id_col), "template_id", "license", "n_shingles", F.col("best.containment").alias("containment"),
        (-F.col("best.back")).alias("start_word"), F.col("best.n_words").alias("n_words"),
    )


def oracle_sql(templates: Sequence[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same matches by counting shared shingles in every window, for DuckDB."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(quoted, x)) + ")" for x in templates)
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(SHINGLE))
    split = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
        WITH t AS (SELECT template_id, license, {split.format('body')} AS w FROM (VALUES {values}) v(template_id, license, body)),
        ts AS (SELECT DISTINCT template_id, license, {shingle} AS s FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM t)),
        size AS (SELECT template_id, count(*) AS n_shingles, greatest(2, cast(pow(2, ceil(log2(count(*) * 4 / 3.0) - 1e-9)) AS BIGINT)) AS width FROM ts GROUP BY 1),
        d AS (SELECT doc_id, {split.format('text')} AS w FROM documents),
        ds AS (SELECT doc_id, i - 1 AS pos, {shingle} AS s FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d)),
        hit AS (SELECT doc_id, pos, template_id, license, s, n_shingles, width, greatest(1, width // 4) AS stride FROM ds JOIN ts USING (s) JOIN size USING (template_id)),
        win AS (SELECT *, (pos // stride - unnest(range(0, width // stride))) * stride AS start FROM hit),
        held AS (SELECT doc_id, template_id, license, n_shingles, start, count(DISTINCT s) / n_shingles AS containment FROM win WHERE start >= 0 GROUP BY doc_id, template_id, license, n_shingles, start)
        SELECT doc_id, template_id, license, cast(n_shingles AS INTEGER) AS n_shingles, round(max(containment), 6) AS containment
        FROM held WHERE containment >= {threshold} GROUP BY doc_id, template_id, license, n_shingles
    """
