"""Quality rules whose thresholds adapt to each language and source.

Every document gets integer measures of its whole text. Per language, source and measure a quantile sketch counts
the documents in buckets whose width is 1/64 of their value or less (exact below 128). Such sketches merge by adding
counts, in any order and with the same result, so a hot source is combined on the map side, and the sketches of all
sources of a language merge to the sketch of the language, and those of all languages to one of the whole table.
No group's thresholds change abruptly with its size: a source's fence is the mean of its own and its language's, weighed by the
group's rows against ``prior_rows``, and a language's fence likewise of its own and the whole table's. Where a measure belongs to the
language, as the length of words and the share of capitals do, no language is judged by others: the wider of its own fence
and that mean counts.

Thresholds are far-out fences around the quartiles: a document is rejected if a measure lies above
q75 + 3 * spread, or, for the length of words, below q25 - 3 * spread. The spread is the quartile distance, but at least
the measure's resolution, so a group whose documents are all alike still admits ordinary variation.

Only DataFrame functions are used. Each document is measured once: the measures, not the texts, are written to the
scratch folder, grouped and joined. At most 64 * 57 buckets exist per group and measure.

Windows of three words are compared by 64-bit hashes inside one document.

Defined results: null and empty texts have no words and fail the base rules; null languages and sources form groups
of their own; repeated rows are measured like any others; an empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portfold.llm.support import WHITE_SPACE, let, without, words, written

# Measure: resolution (least spread), whether small values are rejected too, and whether it belongs to the language.
MEASURES = {
    "symbols_per_1000_words": (40, False, False),
    "dup_lines_per_1000_lines": (120, False, False),
    "repeats_per_1000_words": (100, False, False),
    "uppercase_per_1000_chars": (60, False, True),
    "marks_per_1000_words": (100, False, False),
    "chars_per_100_words": (60, True, True),
}
FENCE = 3
PRIOR_ROWS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# The characters that count as symbols, and those that count as loud marks.
SYMBOLS = "#*$%&|<>"
MARKS = r"!?~^_=+{}\[\]\\@"


def _number_of(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def _repeat_words(parts: Column) -> Column:
    """How many words lie in a window of three words that occurs twice or more."""
    def covered(grams: Column) -> Column:
        def again(gram: Column, i: Column) -> Column:
            return (gram["h"] == F.get(grams, i - 1)["h"]) | (gram["h"] == F.get(grams, i + 1)["h"])
        positions = F.transform(F.filter(grams, again), lambda g: F.array(g["p"], g["p"] + 1, g["p"] + 2))
        return F.size(F.array_distinct(F.flatten(positions)))

    def counted(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(placed, covered))

    starts = F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0)))
    windows = F.transform(starts, lambda w, i: F.xxhash64(w, F.get(parts, i + 1), F.get(parts, i + 2)))
    return let(windows, counted)


def _line_counts(lines: Column) -> Column:
    worded = F.filter(lines, lambda line: line.rlike(f"[^{WHITE_SPACE}]"))
    return let(worded, lambda w: F.struct(F.size(w).alias("n"), (F.size(w) - F.size(F.array_distinct(w))).alias("again")))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with the counts of ``COUNTS`` (long) and the measures of ``MEASURES`` (long)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    of_words = let(words(F.col(text)), lambda w: F.struct(
        F.size(w).alias("n"), F.length(F.concat_ws("", w)).alias("chars"), _repeat_words(w).alias("repeated")))
    own = {*COUNTS, *MEASURES}
    counted = without(df, own).select(
        *[f"`{c}`" for c in df.columns if c.lower() not in own and c != text],
        of_words.alias("_words"), _line_counts(F.split(whole, "\n")).alias("_lines"),
        F.regexp_replace(whole, rf"[^\p{{Lu}}{SYMBOLS}{MARKS}]+", "").alias("_special"),
    )
    long = lambda name, as_name: F.col(name).cast("long").alias(as_name)
    counted = counted.select(
        "*", long("_words.n", "n_words"), long("_words.repeated", "n_repeat_words"), long("_lines.again", "n_dup_lines"),
        long("_words.chars", "word_chars"), long("_lines.n", "_n_lines"), _number_of(F.col("_special"), SYMBOLS).alias("n_symbols"),
        _number_of(F.col("_special"), MARKS).alias("_marks"), _number_of(F.col("_special"), r"\p{Lu}").alias("_upper"),
    )

    def share(scale: int, part: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.expr(f"{scale}L * `{part}` div `{of}`")).otherwise(F.lit(0).cast("long"))

    return counted.select(
        "*", share(1000, "n_symbols", "n_words").alias("symbols_per_1000_words"),
        share(1000, "n_dup_lines", "_n_lines").alias("dup_lines_per_1000_lines"),
        share(1000, "n_repeat_words", "n_words").alias("repeats_per_1000_words"),
        share(1000, "_upper", "word_chars").alias("uppercase_per_1000_chars"),
        share(1000, "_marks", "n_words").alias("marks_per_1000_words"),
        share(100, "word_chars", "n_words").alias("chars_per_100_words"),
    ).drop("_words", "_lines", "_special", "_marks", "_upper", "_n_lines")


def bucket(value: Column) -> Column:
    """The lower end of the sketch bucket: the value's seven leading binary digits, the others zero."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    power = F.pow(F.lit(2), shift).cast("long")
    return (F.floor(value / power) * power).cast("long")


def _key(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def sketches(df: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Merged sketches (level, lang key, source key, measure, bucket, n) of groups, languages and the whole table."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])
    long = df.select(_key(lang).alias("lang_key"), _key(source).alias("source_key"), F.inline(pairs))
    group = long.groupBy("lang_key", "source_key", "measure", "bucket").agg(F.count("*").alias("n"))
    group = written(group, "sketches")
    levels = [
        (0, F.col("lang_key"), F.col("source_key")), (1, F.col("lang_key"), F.lit("")), (2, F.lit(""), F.lit("")),
    ]
    merged = [
        group.groupBy(F.lit(level).alias("level"), a.alias("lang_key"), b.alias("source_key"), "measure", "bucket")
        .agg(F.sum("n").alias("n")) for level, a, b in levels
    ]
    return merged[0].unionByName(merged[1]).unionByName(merged[2])


def quartiles(merged: DataFrame) -> DataFrame:
    """Rows, lower and upper quartile of every sketch. A window holds one sketch, whose size is bounded."""
    sketch = Window.partitionBy("level", "lang_key", "source_key", "measure")
    ranked = merged.select(
        "*", F.sum("n").over(sketch).alias("rows"),
        F.sum("n").over(sketch.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("up_to"),
    )
    return ranked.groupBy("level", "lang_key", "source_key", "measure").agg(
        F.max("rows").alias("rows"),
        F.min(F.when(4 * F.col("up_to") >= F.col("rows"), F.col("bucket"))).alias("q25"),
        F.min(F.when(4 * F.col("up_to") >= 3 * F.col("rows"), F.col("bucket"))).alias("q75"),
    )


def thresholds(df: DataFrame, lang: str = "lang", source: str = "source", *, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """One row per language and source: its rows, and ``<measure>_low`` and ``<measure>_high`` for each measure."""
    found = quartiles(sketches(df, lang, source))
    columns = []
    for measure, (resolution, both, _) in MEASURES.items():
        of = lambda name, m=measure: F.max(F.when(F.col("measure") == m, F.col(name)))
        spread = F.greatest(of("q75") - of("q25"), F.lit(resolution).cast("long"))
        low = F.greatest(of("q25") - FENCE * spread, F.lit(0).cast("long")) if both else F.lit(0).cast("long")
        columns += [low.alias(f"{measure}_low"), (of("q75") + FENCE * spread).alias(f"{measure}_high")]
    fences = written(
        found.groupBy("level", "lang_key", "source_key").agg(F.max("rows").alias("rows"), *columns), "fences")
    names = [f"{m}_{end}" for m in MEASURES for end in ("low", "high")]

    def level(k: int, *keys: str) -> DataFrame:
        packed = F.struct("rows", *names).alias(f"level{k}")
        # "table" is 2 on every level; as it is computed from the rows, Spark keeps it as a join key.
        return fences.where(F.col("level") == k).select(*keys, (F.col("level") + (2 - k)).alias("table"), packed)

    def mean(own: str, other: Column, name: str) -> Column:
        total = F.col(f"{own}.{name}") * F.col(f"{own}.rows") + other * prior_rows
        return F.floor(total / (F.col(f"{own}.rows") + prior_rows)).cast("long")

    languages = []
    for measure, (_, _, of_language) in MEASURES.items():
        for end, wider in (("low", F.least), ("high", F.greatest)):
            name = f"{measure}_{end}"
            borrowed = mean("level1", F.col(f"level2.{name}"), name)
            languages.append((wider(borrowed, F.col(f"level1.{name}")) if of_language else borrowed).alias(name))
    of_languages = level(1, "lang_key").join(level(2), "table").select("lang_key", F.struct(*languages).alias("language"))
    groups = level(0, "lang_key", "source_key").join(of_languages, "lang_key")
    chosen = F.struct(*[mean("level0", F.col(f"language.{name}"), name).alias(name) for name in names])
    return groups.select("lang_key", "source_key", F.col("level0.rows").alias("group_rows"), chosen.alias("fence"))


def _judged(rows: DataFrame, prior_rows: int) -> DataFrame:
    """Measured rows with ``base_failed`` and ``kept``."""
    fences = thresholds(rows, prior_rows=prior_rows)
    keyed = rows.withColumns({"lang_key": _key("lang"), "source_key": _key("source")})
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.lit(True)
    for measure in MEASURES:
        inside = inside & F.col(measure).between(F.col(f"fence.{measure}_low"), F.col(f"fence.{measure}_high"))
    return keyed.join(fences, ["lang_key", "source_key"]).withColumns({"base_failed": base, "kept": ~base & inside})


def apply_rules(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", *, doc_id: str = "doc_id",
    prior_rows: int = PRIOR_ROWS,
) -> DataFrame:
    """Ids with counts, measures, ``base_failed`` and ``kept``; one row per row of ``df``."""
    slim = df.select(F.col(doc_id).alias("_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    judged = _judged(written(measured(slim), "measures"), prior_rows)
    return judged.select(F.col("_id").alias(doc_id), *COUNTS, "base_failed", "kept", *MEASURES)


def keep_good(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", *, prior_rows: int = PRIOR_ROWS,
) -> DataFrame:
    """The rows of ``df`` that the rules keep, with all their columns.

    The rows are written once with their measures, as measuring costs far more than writing.
    """
    names = [f"`{c}`" for c in df.columns]
    rows = df.select(
        F.struct(*names).alias("_row"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"),
    )
    rows = written(measured(rows), "measures")
    return _judged(rows, prior_rows).where("kept").select("_row.*")
