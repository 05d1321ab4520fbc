"""Blocked similarity joins: equi joins on exact keys, then verification.

No pair of a group is tried just because it shares the group.  Each rule has a key that a
true pair is sure to share, and the keys are chosen so that few others share it:

* prefix and suffix rules: the shorter text equals a prefix (suffix) of the longer one;
* up to 19 characters (one edit): both share a text with one character deleted;
* from 18 characters: both share one of their rarest 5-grams (prefix filter; Bayardo et al.,
  WWW 2007; Xiao et al., Ed-Join, VLDB 2008).  A gram that stays frequent even there is
  replaced by pairs of grams;
* one inserted qualifier: three of the four quarters of the shorter text, in place.

All inputs are distinct texts per scope, so copies of a name never multiply the work.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import computed_here
from shelfmark.operators.stable import dropped, pinned, spread, stored

GRAM = 5            # long enough to be rare, short enough that true pairs of any length share one
LONG_GRAMS = (8, 6)  # the same for longer texts, where they are far rarer; the first that can hold
SLOTS = 1 << 17     # grams are counted by hashed slots
HOT = 500           # a gram shared by more texts than this is refined to gram pairs
PASS_BYTES = 512 << 20  # bytes of keys, each with its text, that one pass shuffles; they compress about sixfold


def _edits(length: Column, share: float) -> Column:
    return F.floor(length * F.lit(share) + F.lit(1e-9)).cast("int")


def _edits_with_any_partner(length: Column, share: float) -> Column:
    """Edits allowed with the longest partner a text of this length can have."""
    longest = F.floor(length / F.lit(1.0 - share) + F.lit(1e-9))
    return _edits(longest, share)


def _verified(pairs: DataFrame, min_similarity: float) -> DataFrame:
    """Edit distance with an early stop at the allowed edits, then the exact similarity test."""
    la, lb = F.length("a"), F.length("b")
    longest = F.greatest(la, lb)
    allowed = _edits(longest, round(1.0 - min_similarity, 10))
    near = pairs.where((la >= 10) & (lb >= 10) & (F.abs(la - lb) <= allowed))
    near = computed_here(near, edits=F.call_function("levenshtein", F.col("a"), F.col("b"), allowed))
    sim = F.lit(1.0) - F.col("edits").cast("double") / longest.cast("double")
    return (
        near.where("edits >= 0").withColumn("sim", sim).where(F.col("sim") >= min_similarity)
        .drop("edits").distinct()
    )


def _self_join(keys: DataFrame, share: float, low: int = 0) -> DataFrame:
    """keys(scope, block, text, n, at) -> (scope, a, b), a before b, lengths ``n`` (the longer one at least ``low``) and the place of the
    shared gram within the allowed edits (``at`` is NULL where the place is not unique)."""
    left = keys.select("scope", "block", F.col("text").alias("a"), F.col("n").alias("la"), F.col("at").alias("at_a"))
    right = keys.select("scope", "block", F.col("text").alias("b"), F.col("n").alias("lb"), F.col("at").alias("at_b"))
    longest = F.greatest("la", "lb")
    allowed = _edits(longest, share)
    near = (longest >= low) & (F.abs(F.col("la") - F.col("lb")) <= allowed) & F.coalesce(F.abs(F.col("at_a") - F.col("at_b")) <= allowed, F.lit(True))
    return left.join(right, ["scope", "block"]).where(near & (F.col("a") < F.col("b"))).select("scope", "a", "b")


def _one_edit_pairs(texts: DataFrame, share: float) -> DataFrame:
    """Texts that share a one-deletion variant.  A variant is shared by at most
    (length + 1) x alphabet distinct texts, whatever the table holds."""
    n = F.length("text")
    cut = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.concat(F.left(F.col("text"), i - 1), F.substr(F.col("text"), i + 1)),
    )
    keys = texts.select(
        "scope", "text", n.alias("n"), F.explode(F.array_distinct(F.concat(F.array("text"), cut))).alias("block"),
        F.lit(None).cast("int").alias("at"),
    )
    return _self_join(keys, share)


def _certain_from(gram: int, share: float) -> int:
    """Least length from which texts within the allowed edits surely share a gram of this size."""
    sure = [n - (gram - 1) - gram * int(n * share + 1e-9) >= 1 for n in range(400)]
    return len(sure) - sure[::-1].index(False)


def _slot_counts(slots: DataFrame) -> DataFrame:
    """One row: ``counts``, how often each of the SLOTS slots occurs.  Its size is fixed, so it may be broadcast."""
    n = slots.groupBy("slot").agg(F.count("*").alias("n"))
    every = slots.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(n, "slot", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("n", F.lit(0)).alias("n")))).alias("c"))
    return pinned(row.select(F.col("c.n").alias("counts")))


def _ranked_grams(texts: DataFrame, share: float, gram_size: int = GRAM) -> DataFrame:
    """(scope, text, needed, distinct_grams, front): the rarest grams of each text, those that a partner surely shares and one more."""
    grams = texts.select(
        "scope", "text",
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.length("text") - (gram_size - 1)),
                lambda i: F.substr(F.col("text"), i, F.lit(gram_size)),
            )
        ).alias("grams"),
    )
    slot = lambda g: F.pmod(F.xxhash64(g), F.lit(SLOTS)).cast("int")
    counted = _slot_counts(grams.select(F.explode(F.transform("grams", slot)).alias("slot")))
    needed = (gram_size * _edits_with_any_partner(F.length("text"), share) + 1).alias("needed")
    # Any order that all texts share will do; by slot counts the rarest come first or nearly so, and no gram has to be
    # joined with its count.
    ordered = F.array_sort(F.transform("grams", lambda g: F.struct(F.get("counts", slot(g)).alias("weight"), g.alias("gram"))))
    return grams.join(F.broadcast(counted)).select("scope", "text", ordered.alias("g")).select(
        "scope", "text", needed, F.size("g").alias("distinct_grams"), F.slice(F.col("g.gram"), F.lit(1), needed + 1).alias("front"),
    )


def _gram_pairs(texts: DataFrame, min_similarity: float, share: float, gram_size: int = GRAM) -> list[DataFrame]:
    """Verified pairs that share one of their rarest grams, or two where one is too frequent.  A key goes with its text, so a large table is
    joined in passes: each takes the pairs whose longer text falls into one range of lengths (a range with too many keys is split by
    hashed grams) and is written before the next starts, so the keys on disk at a time don't grow with the table."""
    ranked = stored(_ranked_grams(texts, share, gram_size))
    ranges = _length_ranges(ranked)
    if len(ranges) == 1 and ranges[0][2] == 1:
        return [_verified(_self_join(_gram_keys(ranked, 0, 1), share), min_similarity)]
    found = []
    for low, high, parts in ranges:
        n = F.length("text")
        mine = ranked.where((n >= _shortest_partner(low, share)) & (n < high))
        for k in range(parts):
            found.append(stored(_verified(_self_join(_gram_keys(mine, k, parts), share, low), min_similarity)))
    dropped(ranked)
    return found


def _length_ranges(ranked: DataFrame) -> list[tuple[int, int, int]]:
    """(low, high, parts): ranges of lengths with about PASS_BYTES of keys each, and the parts that a single step of lengths needs beyond
    that.  Lengths are counted in steps of a twentieth, so a few hundred rows tell them."""
    n = F.length("text")
    steps = ranked.groupBy(F.floor(F.log(n) / F.log(F.lit(1.05))).alias("step")).agg(
        F.min(n).alias("low"), F.max(n).alias("high"), F.sum(n.cast("bigint") * F.least("distinct_grams", "needed")).alias("bytes")
    ).orderBy("step").collect()
    ranges, held = [], 0
    for s in steps:
        if ranges and held + s["bytes"] <= PASS_BYTES:
            held += s["bytes"]
            ranges[-1] = (ranges[-1][0], s["high"] + 1, 1)
        else:
            held = s["bytes"]
            ranges.append((s["low"], s["high"] + 1, held // PASS_BYTES + 1))
    return ranges or [(0, 1, 1)]


def _gram_keys(ranked: DataFrame, part: int, parts: int) -> DataFrame:
    """The keys of ranked texts whose hash falls into one of ``parts``."""
    ours = lambda df, key: df if parts == 1 else df.where(F.pmod(F.xxhash64("scope", key), F.lit(parts)) == part)
    every = ranked.select("scope", "text", F.length("text").alias("n"), "needed", F.posexplode("front").alias("pos", "gram")).where("pos < needed")
    rows = ours(every, "gram")
    frequent = lambda df: df.groupBy("scope", "gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("scope", "gram")
    first = F.call_function("locate", F.col("gram"), F.col("text"))
    once = F.call_function("locate", F.col("gram"), F.col("text"), first + 1) == 0
    cold_keys = rows.join(frequent(rows), ["scope", "gram"], "left_anti").select(
        "scope", "text", "n", F.col("gram").alias("block"), F.when(once, first).alias("at")
    )
    # A key of two grams belongs to the part of its own hash, whatever parts its grams are in.
    hot_rows = every.join(frequent(every), ["scope", "gram"], "left_semi").select("scope", "text", "gram")
    paired = hot_rows.join(ranked, ["scope", "text"]).select(
        "scope", "text", "gram", "needed", "distinct_grams", F.explode("front").alias("other")
    )
    pair_keys = paired.where("gram <> other").select(
        "scope", "text", F.concat_ws("\x01", F.least("gram", "other"), F.greatest("gram", "other")).alias("block")
    )
    # Texts so repetitive that two shared grams are not certain keep the single gram too.
    single_keys = (
        paired.where("distinct_grams < needed + 1").select("scope", "text", F.col("gram").alias("block")).distinct()
    )
    refined = ours(pair_keys.unionByName(single_keys), "block").distinct().select(
        "scope", "text", F.length("text").alias("n"), "block", F.lit(None).cast("int").alias("at")
    )
    return cold_keys.unionByName(refined)


def near_pairs(texts: DataFrame, min_similarity: float) -> DataFrame:
    """(scope, a, b, sim): all pairs of texts of one scope, both ten characters or longer, whose
    edit similarity reaches ``min_similarity`` (0.86 or more).  ``texts`` is distinct (scope, text)."""
    share = round(1.0 - min_similarity, 10)
    texts = spread(texts, "scope", "text")
    two_edits_from = next(n for n in range(10, 40) if int(n * share + 1e-9) >= 2)
    long_gram = next(g for g in LONG_GRAMS if g * share < 0.9)
    long_from = _certain_from(long_gram, share)
    n = F.length("text")
    # Pairs are grouped by the length of their longer text; its partner may be a little shorter.
    one_edit = texts.where(n.between(10, two_edits_from - 1))
    middle = texts.where(n.between(_shortest_partner(two_edits_from, share), long_from - 1))
    long = texts.where(n >= _shortest_partner(long_from, share))
    # Candidates are verified where they meet; only the pairs that hold move on.
    found = [_verified(_one_edit_pairs(one_edit, share), min_similarity)]
    found += _gram_pairs(middle, min_similarity, share)
    found += _gram_pairs(long, min_similarity, share, long_gram)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _shortest_partner(longest: int, share: float) -> int:
    return longest - int(longest * share + 1e-9)


def prefix_pairs(shorts: DataFrame, longs: DataFrame, min_length: int, from_end: bool = False) -> DataFrame:
    """(scope, short, long) where short is a proper prefix (suffix) of long.  Both inputs are
    distinct (scope, text).  A long text yields one key per length, so output grows linearly."""
    cut = F.right if from_end else F.left
    n = F.length("text")
    keys = longs.where(n > min_length).select(
        "scope", F.col("text").alias("long"),
        F.explode(F.transform(F.sequence(F.lit(min_length), n - 1), lambda i: cut(F.col("text"), i))).alias("short"),
    )
    known = shorts.where(n >= min_length).select("scope", F.col("text").alias("short"))
    return keys.join(known, ["scope", "short"]).select("scope", "short", "long")


def inserted_pairs(texts: DataFrame, min_length: int = 10, max_insert: int = 8) -> DataFrame:
    """(scope, short, long) where long is short with one run of 1-8 characters inserted.  The
    insertion falls into one quarter of short; the other three stay in place."""

    def quarters(text: Column, length: Column, total: Column) -> Column:
        # length: characters of the short text; total: characters of this text
        return F.transform(
            F.sequence(F.lit(0), F.lit(3)),
            lambda i: F.concat_ws(
                "\x01", length.cast("string"), i.cast("string"),
                F.left(text, F.floor(length * i / 4).cast("int")),
                F.right(text, length - F.floor(length * (i + 1) / 4).cast("int")),
            ),
        )

    n = F.length("text")
    shorts = texts.where(n >= min_length).select(
        "scope", F.col("text").alias("short"), F.explode(quarters(F.col("text"), n, n)).alias("block")
    )
    longs = texts.where(n > min_length).select(
        "scope", F.col("text").alias("long"),
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.greatest(F.lit(min_length), n - max_insert), n - 1),
                    lambda s: quarters(F.col("text"), s, n),
                )
            )
        ).alias("block"),
    )
    s, lg = F.col("short"), F.col("long")
    extra = F.length(lg) - F.length(s)
    # Some cut point splits short so that both parts frame the insertion.
    framed = F.exists(
        F.sequence(F.lit(0), F.length(s)),
        lambda i: F.concat(F.left(lg, i), F.right(lg, F.length(s) - i)) == s,
    )
    return (
        shorts.join(longs, ["scope", "block"]).where(extra.between(1, max_insert))
        .select("scope", "short", "long").distinct().where(framed)
    )
