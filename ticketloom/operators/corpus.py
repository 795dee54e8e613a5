"""Corpus building: near-duplicate removal, source mixing, grouped splits, folds, generated text.

Random choices are hash orders of the row's own key, so results repeat on any cluster. Orders
inside a class are numbered in two levels (see scale.running_sum): one class may hold most rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import dedupe_key
from .scale import hash_bucket, hash_order, join_same, running_sum, salted_join


def dedupe_groups(rows: DataFrame, group: Column, order: str = "row_id") -> DataFrame:
    """First row per near-duplicate key, as an aggregate over the ids and a join on the unique id.

    Only ids travel with the keys; a key shared by a third of all rows combines on the map side.
    """
    first = rows.select(order, group.alias("__group")).groupBy("__group").agg(F.min(order).alias(order))
    return rows.join(first.select(order), order, "left_semi")


def dedupe_text(rows: DataFrame, text: str = "text", order: str = "row_id") -> DataFrame:
    """First row per exact text; texts are compared by their fingerprint and length."""
    return dedupe_groups(rows, F.struct(F.sha2(F.col(text).cast("binary"), 256), F.length(text)), order)


def balanced_weights(rows: DataFrame, label: str = "category") -> DataFrame:
    """Adds `weight` = rows / (classes x rows of the class); multiplies an existing weight."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    average = counts.agg((F.sum("__n") / F.count("*")).alias("average")).scalar()
    factors = counts.select(label, (average / F.col("__n")).alias("__factor"))
    base = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    # one row per class; Spark broadcasts it by its measured size
    return join_same(rows, factors, [label]).withColumn("weight", base * F.col("__factor")).drop("__factor")


def ranked(rows: DataFrame, group: Sequence[str], key: Column | str, seed: str, name: str = "rank") -> DataFrame:
    """Rows numbered per group in the hash order of `key`."""
    keyed = rows.withColumn("__h", hash_order(key, seed=seed))
    tie = F.col(key) if isinstance(key, str) else key
    return running_sum(keyed, group, ["__h", tie], hash_bucket("__h"), name=name).drop("__h")


def mix_sources(first: DataFrame, second: DataFrame, per_class: int, share: float = 0.5, seed: str = "mix") -> DataFrame:
    """Up to `per_class` rows per category: at most `share` of them from `first`, the rest from
    `second`, which contributes no text (after trimming and lower-casing) twice or already taken.

    Inputs: row_id, text, category, source, grp. The quota is the feature here, not a cap on work.
    """
    quota = int(per_class * share)
    columns = ["row_id", "text", "category", "source", "grp"]
    ordered = ranked(first.select("row_id", "category"), ["category"], "row_id", seed).filter(F.col("rank") <= quota)
    taken = first.join(ordered.select("row_id"), "row_id", "left_semi").select(*columns)
    have = ordered.groupBy("category").agg(F.count("*").alias("have"))
    keyed = second.select("row_id", "category", F.sha2(dedupe_key("text").cast("binary"), 256).alias("key"))
    seen = taken.select("category", F.sha2(dedupe_key("text").cast("binary"), 256).alias("key")).distinct()
    unique = join_same(keyed.groupBy("category", "key").agg(F.min("row_id").alias("row_id")), seen, ["category", "key"], "left_anti")
    order = ranked(unique.select("row_id", "category"), ["category"], "row_id", seed)
    room = join_same(order, have, ["category"], "left").filter(F.col("rank") <= per_class - F.coalesce("have", F.lit(0)))
    filled = second.join(room.select("row_id"), "row_id", "left_semi").select(*columns)
    return taken.unionByName(filled)


def grouped_split(rows: DataFrame, seed: str = "42", test: float = 0.15, val: float = 0.15) -> DataFrame:
    """Adds `split` (train, val, test), stratified by category, never dividing a group.

    Groups are laid out per category in hash order; where a group ends in the running share of
    rows decides its split. A group that would overfill test and val therefore goes to train.
    """
    sizes = rows.groupBy("category", "grp").agg(F.count("*").alias("__size"))
    totals = sizes.groupBy("category").agg(F.sum("__size").alias("__total"))
    ordered = running_sum(
        sizes.withColumn("__h", hash_order("grp", seed=seed)), ["category"], ["__h", "grp"], hash_bucket("__h"), F.col("__size"), "__end"
    )
    share = F.col("__end") / F.col("__total")
    split = F.when(share <= test, "test").when(share <= test + val, "val").otherwise("train")
    assigned = join_same(ordered, totals, ["category"]).select("category", "grp", split.alias("split"))
    floor = sizes.agg((F.sum("__size") * F.lit(0.01)).alias("floor")).scalar()
    hot = sizes.filter(F.col("__size") >= floor).select("category", "grp")  # at most 100 groups
    return salted_join(rows, assigned, ["category", "grp"], by="row_id", hot=hot)


def stratified_folds(rows: DataFrame, label: str, folds: int = 5, seed: str = "42") -> DataFrame:
    """Adds `fold`: rows of each label dealt out in hash order, so folds differ by at most one row."""
    return ranked(rows, [label], "row_id", seed, "__n").withColumn("fold", (F.col("__n") - 1) % folds).drop("__n")


def crosstab(rows: DataFrame, other: str) -> DataFrame:
    """Counts of category x `other` with margins; a rolled-up side shows as All."""
    cubed = rows.cube("category", other).agg(F.count("*").alias("n"), F.grouping("category").alias("gc"), F.grouping(other).alias("go"))
    side = lambda c, g: F.when(F.col(g) == 1, "All").otherwise(F.col(c))
    return cubed.select(side("category", "gc").alias("category"), side(other, "go").alias(other), "n")


def split_leaks(rows: DataFrame) -> DataFrame:
    """Groups that occur in more than one split."""
    seen = lambda s: F.max((F.col("split") == s).cast("int"))
    return (
        rows.groupBy("grp")
        .agg((seen("train") + seen("val") + seen("test")).alias("splits"))
        .filter("splits > 1")
    )


# --- generated text ------------------------------------------------------------------------


def weighted_pick(key: Column, weights: Sequence[tuple[str, int]]) -> Column:
    """A name drawn by integer weights from a hash key."""
    total = sum(w for _, w in weights)
    draw = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") % total
    out, edge = None, 0
    for name, weight in weights:
        edge += weight
        out = F.when(draw < edge, name) if out is None else out.when(draw < edge, name)
    return out


def expand_templates(requests: DataFrame, templates: DataFrame, slots: dict[str, Sequence[str]], seed: str = "gen") -> DataFrame:
    """One generated text per request (request_id, category) from the templates of its category.

    Templates are (category, position from 0, template); {slot} names are filled from `slots`. The
    template and each slot value are hash picks, so a request always yields the same text.
    """
    per_category = templates.groupBy("category").agg(F.count("*").alias("__n"))
    drawn = F.conv(F.substring(hash_order("request_id", seed=f"{seed}.template"), 1, 8), 16, 10).cast("bigint")
    keyed = requests.join(per_category, "category").withColumn("position", drawn % F.col("__n")).drop("__n")
    text = F.col("template")
    for name, values in slots.items():
        draw = F.conv(F.substring(hash_order("request_id", seed=f"{seed}.{name}"), 1, 8), 16, 10).cast("bigint") % len(values)
        text = F.replace(text, F.lit("{" + name + "}"), F.element_at(F.array(*map(F.lit, values)), (draw + 1).cast("int")))
    group = F.concat("category", F.lit(":core"), F.col("position").cast("string"))
    return keyed.join(templates, ["category", "position"]).select(
        F.col("request_id").alias("row_id"), text.alias("text"), "category", F.lit("template").alias("source"), group.alias("grp")
    )


def augment_noise(rows: DataFrame, text: str = "text", seed: str = "noise", per_hundred: int = 10) -> DataFrame:
    """Lower case, no closing punctuation, and a swapped or dropped letter in about one long word of ten."""
    words = F.split(F.regexp_replace(F.lower(text), r"[.!]+$", ""), r"(?U)\s+")

    def typo(word: Column, i: Column) -> Column:
        key = F.md5(F.concat_ws("|", F.lit(seed), F.col("row_id").cast("string"), i.cast("string")).cast("binary"))
        part = lambda start: F.conv(F.substring(key, start, 4), 16, 10).cast("bigint")
        at = (part(5) % (F.length(word) - 3) + 2).cast("int")  # 1-based, never the first letter
        head, here, after = F.substr(word, F.lit(1), at - 1), F.substr(word, at, F.lit(1)), F.substr(word, at + 1, F.lit(1))
        rest = F.substr(word, at + 2)
        changed = F.when(part(9) % 2 == 0, F.concat(head, after, here, rest)).otherwise(F.concat(head, after, rest))
        hit = (F.length(word) >= 5) & word.rlike(r"(?U)^\p{IsAlphabetic}+$") & (part(1) % 100 < per_hundred)
        return F.when(hit, changed).otherwise(word)

    return rows.withColumn(text, F.array_join(F.transform(F.filter(words, lambda w: w != ""), typo), " "))


# Share of each phrasing level
LEVEL_WEIGHTS = (("none", 28), ("calm", 14), ("medium", 28), ("high", 18), ("stakes", 12))


def augment_urgency(rows: DataFrame, phrases: dict[str, Sequence[str]], variants: int = 2, seed: str = "urgency") -> DataFrame:
    """`variants` urgency wrappings of every text: a level by weight, then a phrase of that level put
    before or after the text. Level `none` keeps the text. Adds `level` and `variant`."""
    many = rows.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants))))
    key = lambda what: hash_order("row_id", "variant", seed=f"{seed}.{what}")
    draw = lambda what, n: F.conv(F.substring(key(what), 1, 8), 16, 10).cast("bigint") % n
    levelled = many.withColumn("level", weighted_pick(key("level"), LEVEL_WEIGHTS))
    phrase = F.lit(None).cast("string")
    for level, options in phrases.items():
        chosen = F.element_at(F.array(*map(F.lit, options)), (draw(level, len(options)) + 1).cast("int"))
        phrase = F.when(F.col("level") == level, chosen).otherwise(phrase)
    body = F.rtrim("text")
    wrapped = F.when(draw("side", 4) == 0, F.concat(phrase, F.lit(" "), body)).otherwise(F.concat(body, F.lit(" "), phrase))
    return levelled.withColumn("text", F.coalesce(F.when(F.col("level") != "none", wrapped), F.col("text")))
