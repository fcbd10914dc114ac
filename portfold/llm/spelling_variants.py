"""Words that differ by one letter, found with bit-sliced position indexes.

Two words are near if one inserted, deleted or replaced code point turns one into the other. The longer or equal word of a pair
differs at the length of their common prefix, which lies in the first or the second half of the shorter word. So every word
is put under the letters before and behind either half, as the shorter and as the longer of a pair, and near words
share exactly one such shard. A shard that holds more than ``SHARD_WORDS`` words, or ``SHARD_LETTERS`` letters in what they may differ in, is
split again: its half is halved and its words get longer keys. With one open letter the alphabet bounds the shard, so no
shard grows with the vocabulary, however many words begin alike.

A shard has a bitset of its words for each open position and letter. A word is compared with all others at once: letter by letter the
set of words without an error so far, and the sets with one replaced or one further letter, are narrowed by the bitset of
that letter, at the same position or at the one behind it. A shard yields one row per word that has near words there: how many, and the
most frequent one. Spark adds these up, so pairs are never written.

Chains of forms end after at most 64 steps, as counts at least double (``least_ratio`` > 1), and are followed by doubling.

Defined results: null and empty texts have no words; a null id counts as empty text where ``variants`` takes it; repeated rows count
again; ties go to the smallest word in code-point order; other input columns are left out; an empty table gives an empty result.
"""

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portfold.llm.support import written

SHARD_WORDS = 2048
SHARD_LETTERS = 1 << 19
# The letters that make up words, and those of them that are lower-cased.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs_of_letters(text: Column) -> Column:
    """The maximal runs of letters of the whole text, A to Z in lower case; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({LETTERS})"))


def counted_words(words: DataFrame, *, least_length: int, least_count: int) -> DataFrame:
    """``word`` and ``n`` of the words (column ``word``) that are long and frequent enough."""
    long = words.where(F.char_length("word") >= least_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _near_in_shard(words: list[str], counts: list[int], length: int, low: int, high: int) -> Iterator[tuple[str, int, str, int]]:
    """For each word with near words in the shard: the word, how many, the most frequent, its count.

    The shard's words have ``length`` letters, or one more, and agree but for the letters from ``low`` to ``high`` (one further in the
    longer ones). Both words of a pair get each other.
    """
    width = high - low
    index: list[dict[str, int]] = [defaultdict(int) for _ in range(width + 1)]
    # In this order the lowest bit of any set is the best word: by falling count, then by code points.
    ranked = sorted(range(len(words)), key=lambda i: (-counts[i], words[i].encode()))
    same = 0
    for bit, i in enumerate(ranked):
        longer = len(words[i]) > length
        if not longer:
            same |= 1 << bit
        for position, letter in enumerate(words[i][low:high + longer]):
            index[position][letter] |= 1 << bit
    longer = (1 << len(ranked)) - 1 ^ same
    near = [0] * len(ranked)
    append = high == length  # the last half also holds the place behind the last letter
    for bit, i in enumerate(ranked):
        if longer >> bit & 1:
            continue
        word = words[i]
        none, replaced, inserted = (1 << len(ranked)) - 1, 0, 0
        for position in range(width):
            letter = word[low + position]
            here = index[position].get(letter, 0)
            behind = index[position + 1].get(letter, 0)
            differ = none & ~here
            replaced = replaced & here | differ & same
            inserted = inserted & behind | differ & behind & longer
            none &= here
            if not (none | replaced | inserted):
                break
        found = replaced | inserted | (none & longer if append else 0)
        if not found:
            continue
        near[bit] |= found
        other = found
        while other:
            lowest = other & -other
            near[lowest.bit_length() - 1] |= 1 << bit
            other ^= lowest
    for bit, found in enumerate(near):
        if found:
            best = ranked[(found & -found).bit_length() - 1]
            yield words[ranked[bit]], found.bit_count(), words[best], counts[best]


def _near_in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, length, low, high, word, n), sorted by shard, to rows (word, n_near, form, form_n). One shard is held at a time."""
    held, words, counts = None, [], []

    def result() -> list[tuple[str, int, str, int]]:
        return list(_near_in_shard(words, counts, *held[1:])) if len(words) > 1 else []

    names = ["word", "n_near", "form", "form_n"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        rows = []
        for *shard, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if shard != held:
                rows += result()
                held, words, counts = shard, [], []
            words.append(word)
            counts.append(n)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    rows = result()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, length, low, high) with ``key``: the letters before ``low``, a blank, those behind ``high``, from the end."""
    before = F.col("word").substr(F.lit(1), F.col("low"))
    behind = F.col("length") - F.col("high")
    after = F.col("word").substr(F.char_length("word") - behind + 1, behind)
    return rows.withColumn("key", F.concat(before, F.lit(" "), after))


def _halves(low: Column, high: Column) -> Column:
    middle = F.floor((low + high) / 2).cast("int")
    return F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high")))


def near_words(words: DataFrame, *, shard_words: int = SHARD_WORDS, shard_letters: int = SHARD_LETTERS) -> DataFrame:
    """``word``, ``n_near``, ``form`` and ``form_n``, the most frequent near word, of all words (``word``, ``n``) that have near words."""
    own = F.char_length("word")
    roles = F.explode(F.array(own, own - 1)).alias("length")
    rows = words.select("word", "n", roles).where("length > 0").select(
        "word", "n", "length", F.inline(F.when(F.col("length") > 1, _halves(F.lit(0), F.col("length"))).otherwise(
            F.array(F.struct(F.lit(0).alias("low"), F.lit(1).alias("high"))))))
    shard = ["key", "length", "low", "high"]
    found = None
    while True:
        rows = written(_keyed(rows), "words_by_shard")
        sizes = rows.groupBy(*shard).agg(F.count("*").alias("size")).where("size > 1")
        # Another form of the key, so that no partitioning is reused and Spark may split a hot shard's rows.
        sizes = sizes.select(F.concat_ws(" ", *shard).alias("shard"), "size")
        large = (F.col("high") - F.col("low") > 1) & (
            (F.col("size") > shard_words) | (F.col("size") * (F.col("high") - F.col("low")) > shard_letters))
        sized = rows.withColumn("shard", F.concat_ws(" ", *shard)).join(sizes, "shard").withColumn("large", large)
        sized = written(sized.drop("shard", "size"), "shards")
        dealt = sized.where("not large").select(*shard, "word", "n").repartition(*shard).sortWithinPartitions(*shard)
        part = dealt.mapInArrow(_near_in_shards, "word string, n_near long, form string, form_n long")
        found = part if found is None else found.unionByName(part)
        rest = sized.where("large")
        if rest.isEmpty():
            break
        rows = rest.select("word", "n", "length", F.inline(_halves(F.col("low"), F.col("high"))))
    # The best: largest count, then smallest word; Spark's order of strings is that of code points.
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    best_of = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return best_of.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of every word that has a form: where the chain of forms ends."""
    ends = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = written(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        if stepped.where("next is not null").isEmpty():
            return stepped.drop("next")
        ends = stepped.drop("next")


def group_variants(words: DataFrame, *, least_ratio: float = 2, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per word of ``words`` (``word``, ``n``): form, root, n, n_near, form_n.

    A word's form is its most frequent near word, if that occurs ``least_ratio`` times as often; its root is where forms end.
    """
    if least_ratio <= 1:
        raise ValueError("least_ratio must be above 1, or chains of forms could close")
    words = written(words.select("word", "n"), "vocabulary")
    near = words.join(near_words(words, shard_words=shard_words), "word", "left")
    often = F.col("form_n") >= least_ratio * F.col("n")
    rows = written(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(often, F.col("form")).alias("form"), F.when(often, F.col("form_n")).alias("form_n")), "forms")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
