"""Near-duplicate removal of product records (group E).

Scores follow the original weighted similarity (name, price, provider, duration).
Greedy leader clustering in quality order is computed exactly, without a quadratic
pair loop:

* rows are reduced to *signatures* (normalised name, price, provider, duration):
  equal signatures score equally against everybody;
* candidate pairs come from blocking: at threshold >= 0.8 a provider match is
  necessary (without it the score is at most 0.5 + 0.2 + 0.1 = 0.7999999999999999), so
  signatures are paired only within a normalised provider; below 0.8 a duration block is
  added; down from 0.7 names alone can do: at 0.7 those of similarity one, found by an equi-join,
  below it all names are a block;
* name similarity is computed where a block makes a name pair (pandas UDF), and only similar pairs go on,
  for the leaders those of the stretch of the order that is being decided;
* pairs are scored where the join makes them; no pair is shuffled or stored before it is scored;
* the greedy order-dependent selection is the lexicographically first independent
  set of the signatures, taken in stretches of the order: only the links within a stretch are
  stored and decided by rounds of joins, each round checkpointed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.functions.similarity import name_similarity_udf, ratio_udf
from pricesieve.operators.name_join import similar_name_candidates
from pricesieve.session import ensure_checkpoint_dir, materialize

_WS = r"[\s\x{1c}-\x{1f}]"


# ------------------------------------------------------------ normalisers
def norm_text(c: Column) -> Column:
    """Lower, strip, non-word characters to spaces, spaces collapsed, a trailing
    'powered by X' cut, stripped; '' for a missing value."""
    t = F.regexp_replace(F.lower(c), rf"(?U)^{_WS}+|{_WS}+$", "")
    t = F.regexp_replace(t, r"(?U)[^\w\s-]", " ")
    t = F.regexp_replace(t, rf"(?U){_WS}+", " ")
    t = F.regexp_replace(t, r"(?U)\s*powered\s*by\s*\w+\s*$", "")
    t = F.regexp_replace(t, rf"(?U)^{_WS}+|{_WS}+$", "")
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(t)


def norm_price(c: Column) -> Column:
    """Missing -> null; containing 'free' -> '$0'; first run of digits and dots ->
    '$' + run; else the lower-cased, stripped text."""
    t = F.regexp_replace(F.lower(c), rf"(?U)^{_WS}+|{_WS}+$", "")
    digits = F.regexp_extract(t, r"(?U)[\d.]+", 0)
    return (
        F.when(c.isNull() | (c == ""), F.lit(None))
        .when(t.contains("free"), F.lit(K.FREE_PRICE))
        .when(digits != "", F.concat(F.lit("$"), digits))
        .otherwise(t)
    )


def norm_duration(c: Column) -> Column:
    """First '<n> minute(s)/min/hour/hr' -> 'n hour' or 'n minute' ('hr' gives minute)."""
    t = F.lower(c)
    num = F.regexp_extract(t, "(?U)" + K.DURATION_PATTERN, 1)
    unit = F.regexp_extract(t, "(?U)" + K.DURATION_PATTERN, 2)
    out = F.when(unit.contains("hour"), F.concat(num, F.lit(" hour"))).otherwise(F.concat(num, F.lit(" minute")))
    return F.when(c.isNull() | (c == "") | (num == ""), F.lit("")).otherwise(out)


def is_malformed(name: Column) -> Column:
    """No name; the corrupted 'A - B Free ... n minutes Powered' shape; more than 10
    words together with 'powered'."""
    words = F.size(F.filter(F.split(name, rf"(?U){_WS}+"), lambda w: w != ""))
    return (
        name.isNull() | (name == "")
        | name.rlike(K.MALFORMED_PATTERN)
        | ((words > 10) & F.lower(name).contains("powered"))
    )


def quality(df: DataFrame) -> Column:
    """E5: price 3, provider 2, description longer than 10 characters 1, a duration 1."""
    p, prov, desc = F.col("price"), F.col("provider"), F.col("description")
    has_price = F.coalesce((p != "") & (p != K.PRICE_NOT_FOUND), F.lit(False))
    return (
        F.when(has_price, K.QUALITY_PRICE).otherwise(0)
        + F.when(F.coalesce(prov != "", F.lit(False)), K.QUALITY_PROVIDER).otherwise(0)
        + F.when(F.coalesce(F.length(desc) > 10, F.lit(False)), K.QUALITY_DESCRIPTION).otherwise(0)
        + F.when(norm_duration(desc) != "", K.QUALITY_DURATION).otherwise(0)
    )


def prepare(products: DataFrame) -> DataFrame:
    """Drop malformed rows, add normalised fields, quality and the processing order
    (quality descending, input order kept for ties)."""
    d = products.filter(~is_malformed(F.col("product_name")))
    d = d.select(
        "row_id", "product_name", "price", "provider", "description",
        norm_text(F.col("product_name")).alias("n_name"),
        norm_price(F.col("price")).alias("n_price"),
        F.when(F.coalesce(F.col("provider") != "", F.lit(False)), norm_text(F.col("provider"))).alias("n_provider"),
        norm_duration(F.col("description")).alias("n_duration"),
        quality(products).alias("quality"),
    )
    return d


def quality_rank(products: DataFrame) -> DataFrame:
    """1-based position in processing order (quality descending, row_id), computed
    with bucketed running counts instead of one global window."""
    from pricesieve.operators.explore import running_totals
    q = products.select("row_id", quality(products).alias("quality"))
    return running_totals(q, "row_id", {"rank": F.lit(1)}, lead=-F.col("quality")).select("row_id", "quality", "rank")


def _ord(df: DataFrame) -> DataFrame:
    """Global processing order as a sortable key (quality desc, row_id): no window needed."""
    return df.withColumn("ord", F.struct((-F.col("quality")).alias("q"), F.col("row_id").alias("r")))


# ---------------------------------------------------------------- pair score
def _numeric(p: Column) -> Column:
    """The price parses as a number once everything but digits and dots is removed."""
    return F.regexp_replace(p, r"[^\d.]", "").rlike(r"^(\d+\.?\d*|\.\d+)$")


def price_similarity(p1: Column, p2: Column, fuzzy: Column) -> Column:
    """Both '$0' -> 1; numbers (non-digits removed) equal -> 1, else 1 - diff / max;
    unparsable -> the fuzzy ratio of the two texts; a missing side -> 0."""
    return _price_score(p1, p2, _price_value(p1), _price_value(p2), fuzzy)


def _price_value(p: Column) -> Column:
    """The number of a price that is one, else null."""
    return F.when(_numeric(p), F.regexp_replace(p, r"[^\d.]", "").try_cast("double"))


def _price_score(p1: Column, p2: Column, f1: Column, f2: Column, fuzzy: Column) -> Column:
    mx = F.greatest(f1, f2)
    num = F.when(f1 == f2, F.lit(1.0)).when(mx > 0, F.lit(1.0) - (F.abs(f1 - f2) / mx)).otherwise(F.lit(0.0))
    return (
        F.when((p1 == K.FREE_PRICE) & (p2 == K.FREE_PRICE), F.lit(1.0))
        .when(p1.isNull() | p2.isNull() | (p1 == "") | (p2 == ""), F.lit(0.0))
        .when(f1.isNotNull() & f2.isNotNull(), num)
        .otherwise(fuzzy)
    )


def name_bound(threshold: float, provider: bool = True, duration: bool = True) -> float:
    """Smallest raw name similarity that can still reach ``threshold`` with full price and,
    as they match, provider and duration terms.  Boosts act only above their limits, so the
    best score is a rising step function of the name similarity; the bound is found by
    bisection.  Above 1: no name can."""
    def best(n: float) -> float:
        if provider and n > K.PROVIDER_BOOST_ABOVE:
            n = min(1.0, n + K.PROVIDER_BOOST)
        if duration and n > K.DURATION_BOOST_ABOVE:
            n = min(1.0, n + K.DURATION_BOOST)
        return K.W_NAME * n + K.W_PRICE + (K.W_PROVIDER if provider else 0.0) + (K.W_DURATION if duration else 0.0)

    if best(1.0) < threshold - 1e-9:
        return 2.0
    low, high = 0.0, 1.0
    if best(low) >= threshold - 1e-9:
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if best(mid) >= threshold - 1e-9 else (mid, high)
    return low - 1e-9


def price_floor(threshold: float) -> float:
    """Smallest price similarity a pair without a duration match can have and still reach
    ``threshold`` (name at most 1, provider 0.2): 0.5 + 0.2 p + 0.2 >= t."""
    return max(0.0, (threshold - 0.7) / 0.2)


def lone_price_floor(threshold: float) -> float:
    """The same for a pair without a provider match either: 0.5 + 0.2 p >= t."""
    return max(0.0, (threshold - 0.5) / 0.2)


def _blocks(sig: DataFrame, threshold: float) -> DataFrame:
    """The signatures once for each block they stand in: ``p:`` their provider, below 0.8 ``d:`` their
    duration, and down from 0.7 ``*``, all names that are not empty."""
    names_count = name_bound(threshold) > 0  # an empty name has similarity 0 with every name
    named = F.col("n_name") != ""
    any_name = named if names_count else F.lit(True)
    ways = [F.when(F.col("n_provider").isNotNull() & any_name, F.concat(F.lit("p:"), F.col("n_provider")))]
    if threshold < 0.8:
        ways.append(F.when((F.col("n_duration") != "") & any_name, F.concat(F.lit("d:"), F.col("n_duration"))))
    if name_bound(threshold, False, False) <= 1.0:
        ways.append(F.when(named, F.lit("*")))
    return sig.select("*", F.explode(F.array_compact(F.array(*ways))).alias("blk"))


#: Names of a block that a task pairs with the names of the other side.
BLOCK_NAMES = 256


def block_names(sig: DataFrame, threshold: float) -> DataFrame:
    """(blk, n_name, n): the names of each block and how many signatures have them, stored."""
    return materialize(_blocks(sig, threshold).groupBy("blk", "n_name").agg(F.count(F.lit(1)).alias("n")))


def name_candidates(sig: DataFrame, threshold: float, later: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """(blk, name1, name2, name_sim): the name pairs of each block that are similar enough to reach
    ``threshold`` there, stored; name1 <= name2 of ``sig``, or name1 of ``sig`` and name2 of ``later``.
    ``named``: the :func:`block_names` of ``sig``, if they are known.
    A pair is scored where it is made, in each block that holds both names, so of all pairs only the
    similar ones are ever shuffled or stored.  Names that must be alike in full to pass without a
    block are those of :func:`alike_names`, not found here."""
    bounds = _name_bounds(threshold)

    def paired(blocks: DataFrame) -> DataFrame:
        return blocks.filter(F.col("blk") != "*") if _alike_only(threshold) else blocks

    def names(of: DataFrame) -> DataFrame:
        return materialize(paired(_blocks(of, threshold).select("blk", "n_name").distinct()))

    first = names(sig) if named is None else paired(named.select("blk", "n_name"))
    second = first if later is None else names(later)
    # the second names of a large block are dealt to several tasks, its first names go to each of them
    parts = second.groupBy("blk").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NAMES).alias("parts"))
    a = first.join(parts, "blk").select(
        "blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("n_name").alias("name1"))
    b = second.join(parts, "blk").select("blk", F.expr("pmod(xxhash64(n_name), parts)").alias("part"), F.col("n_name").alias("name2"))
    n = int(sig.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few small rows make many pairs: not to be coalesced
    pairs = b.repartition(n, "blk", "part").join(a, ["blk", "part"]).filter("name1 <= name2" if later is None else "true")
    pairs = pairs.select("blk", "name1", "name2")
    bound = F.when(F.col("blk").startswith("p:"), bounds["p:"]).when(F.col("blk").startswith("d:"), bounds["d:"]).otherwise(bounds["*"])
    return materialize(_name_scored(pairs).filter(F.col("name_sim") >= bound))


def alike_names(sig: DataFrame, threshold: float) -> DataFrame | None:
    """As :func:`name_candidates`, the pairs that need no block, if only names with a similarity of one
    count there: an equi-join finds them.  Else None."""
    if not _alike_only(threshold):
        return None
    bound = _name_bounds(threshold)["*"]
    names = materialize(sig.filter(F.col("n_name") != "").select(F.col("n_name").alias("name")).distinct())
    near = similar_name_candidates(names, bound).select(F.lit("*").alias("blk"), F.col("a").alias("name1"), F.col("b").alias("name2"))
    return materialize(_name_scored(near).filter(F.col("name_sim") >= bound))


def _name_bounds(threshold: float) -> dict[str, float]:
    return {"p:": name_bound(threshold), "d:": name_bound(threshold, provider=False), "*": name_bound(threshold, False, False)}


def _alike_only(threshold: float) -> bool:
    """A pair without a block needs names of similarity one."""
    return 1 - 1e-6 < _name_bounds(threshold)["*"] <= 1.0


def _name_scored(pairs: DataFrame) -> DataFrame:
    empty = (F.col("name1") == "") | (F.col("name2") == "")
    return pairs.withColumn("name_sim", F.when(empty, F.lit(0.0)).otherwise(name_similarity_udf("name1", "name2")))


def _both_ways(near: DataFrame) -> DataFrame:
    return near.unionByName(near.filter("name1 < name2").select(
        "blk", F.col("name2").alias("name1"), F.col("name1").alias("name2"), "name_sim"))


def _band_width(pmin: float) -> int | None:
    """How many power-of-two bands apart prices of similarity ``pmin`` can be; None: any."""
    import math
    if pmin >= 1.0:
        return 0
    if pmin > 1.0 - 1e-6:
        return 1  # numbers next to each other, perhaps across a band's end
    if pmin <= 0.0:
        return None
    # b / a <= 1 / (1 - pmin) puts floor(log2) bands at most ceil(log2(.)) apart; the
    # small margin keeps ratios a rounding step above the bound (scores are float sums)
    return max(0, int(math.ceil(math.log2(1.0 / (1.0 - pmin)) + 1e-6)))


def _keys(threshold: float, texts: bool, second: bool) -> Column:
    """The keys of a signature in its block, as the first or the ``second`` of a pair.  Two
    signatures share one key at most: their duration, else (in a provider's block) both zero, free
    included, or the power-of-two band of one price, which reaches as far as the bound allows.
    Pairs with a price that is no number have keys of their own (``texts``)."""
    price, duration = F.col("n_price"), F.col("n_duration")
    value = _price_value(price)
    num = F.coalesce(_numeric(price), F.lit(False))
    text, positive = price.isNotNull() & ~num, F.coalesce(value > 0, F.lit(False))
    band = F.floor(F.log2(value)).cast("int")

    def of(width: int | None, by_duration: bool) -> Column:
        if width is None:
            if not texts:
                return F.array(F.when(~text, F.lit("*")))
            return F.array(F.lit("t"), F.when(text, F.lit("u"))) if second else F.array(F.when(text, F.lit("t")).otherwise(F.lit("u")))
        same = F.lit(by_duration) & (duration != "")
        priced = price.isNotNull()
        if not texts:
            reach = range(-width, width + 1) if second else (0,)
            return F.array(F.when(same & ~text, F.concat(F.lit("d:"), duration)), F.when(num & ~positive, F.lit("z")),
                           *(F.when(num & positive, F.concat(F.lit("n:"), (band + k).cast("string"))) for k in reach))
        as_t, as_u = (F.lit(True), text) if second else (text, ~text)
        return F.array(F.when(as_t & priced, F.lit("t")), F.when(as_u & priced, F.lit("u")),
                       F.when(same & as_t, F.concat(F.lit("dt:"), duration)), F.when(same & as_u, F.concat(F.lit("du:"), duration)))

    at_provider = of(_band_width(price_floor(threshold)), True)
    anywhere = of(_band_width(lone_price_floor(threshold)), False)
    keys = F.when(F.col("blk").startswith("p:"), at_provider).when(F.col("blk").startswith("d:"), of(None, False)).otherwise(anywhere)
    return F.array_compact(keys)


def _scored(near: DataFrame, first: DataFrame, second: DataFrame, threshold: float, keep: Column) -> DataFrame:
    """Scored pairs of a ``first`` and a ``second`` signature whose names are a pair of ``near``, each
    once, where ``keep`` (over s1, s2, name1, name2) holds.  Everything a score needs comes with
    the two sides, so pairs are scored where they are made and never shuffled themselves."""
    def side(sig: DataFrame, no: int) -> DataFrame:
        cols = [("sig_id", "s"), ("n_name", "name"), ("n_price", "price"), ("n_provider", "provider"), ("n_duration", "duration")]
        return _blocks(sig, threshold).select(
            "blk", *(F.col(c).alias(f"{short}{no}") for c, short in cols), _price_value(F.col("n_price")).alias(f"value{no}"),
            *(_keys(threshold, texts, no == 2).alias(f"keys_{texts}") for texts in (False, True)))

    a, b = near.join(side(first, 1), ["blk", "name1"]), side(second, 2)

    def pairs(texts: bool) -> DataFrame:
        ka, kb = (d.withColumn("k", F.explode(f"keys_{texts}")).drop("keys_False", "keys_True") for d in (a, b))
        return ka.join(kb, ["blk", "name2", "k"])

    return _pairs_scored(pairs(False), pairs(True), threshold, keep)


def _pairs_scored(numbers: DataFrame, texts: DataFrame, threshold: float, keep: Column) -> DataFrame:
    """The scores of pairs that share a block, similar names and a key ``k``: ``numbers`` by the keys of
    prices that are numbers, ``texts`` by those of pairs with another price."""
    provider = F.coalesce(F.col("provider1") == F.col("provider2"), F.lit(False))
    duration = (F.col("duration1") != "") & (F.col("duration1") == F.col("duration2"))
    # a pair that several blocks or keys would give is left to the first of them
    by_price = _band_width(price_floor(threshold)) is not None
    own = F.when(F.col("blk").startswith("p:"), F.col("k").startswith("d") | ~F.col("duration_match") if by_price else F.lit(True)) \
        .when(F.col("blk").startswith("d:"), ~F.col("provider_match")).otherwise(~F.col("provider_match") & ~F.col("duration_match"))
    both = []
    for by_text, pairs in enumerate((numbers, texts)):
        pairs = pairs.filter(keep)
        pairs = pairs.withColumn("provider_match", provider).withColumn("duration_match", duration).filter(own).select(
            "s1", "s2", "name_sim", "price1", "price2", "value1", "value2", "provider_match", "duration_match")
        if by_text:
            # the fuzzy price ratio is only needed when a price does not parse as a number
            asked = F.col("price1").isNotNull() & F.col("price2").isNotNull()
            both.append(pairs.withColumn("price_ratio", ratio_udf(F.when(asked, F.col("price1")), F.when(asked, F.col("price2")))))
        else:
            both.append(pairs.withColumn("price_ratio", F.lit(None).cast("double")))
    s = both[0].unionByName(both[1])
    n = F.col("name_sim")
    n = F.when(F.col("provider_match") & (n > K.PROVIDER_BOOST_ABOVE), F.least(F.lit(1.0), n + K.PROVIDER_BOOST)).otherwise(n)
    s = s.withColumn("name_sim_b", n)
    n = F.col("name_sim_b")
    n = F.when(F.col("duration_match") & (n > K.DURATION_BOOST_ABOVE), F.least(F.lit(1.0), n + K.DURATION_BOOST)).otherwise(n)
    s = s.withColumn("name_sim_b", n)
    s = s.withColumn("price_sim", _price_score(*(F.col(c) for c in ("price1", "price2", "value1", "value2", "price_ratio"))))
    ps = F.col("price_sim")
    score = (
        F.lit(K.W_NAME) * F.col("name_sim_b") + F.lit(K.W_PRICE) * ps
        + F.when(F.col("provider_match"), F.lit(K.W_PROVIDER)).otherwise(F.lit(0.0))
        + F.when(F.col("duration_match"), F.lit(K.W_DURATION)).otherwise(F.lit(0.0))
    )
    return s.select("s1", "s2", "name_sim", "price_sim", "provider_match", "duration_match", score.alias("score"))


#: Pairs that a task of :func:`pair_scores` makes, if shuffle partitions allow it, and how many signatures
#: of a side a cell holds: at least, at most.
TASK_PAIRS, LEAST_CELL, MOST_CELL = 1 << 24, 1 << 12, 1 << 16


def _cells(near: DataFrame, named: DataFrame) -> tuple[DataFrame, int]:
    """(blk, name2, cut1, cut2), stored: in how many lanes the second signatures with a name, and the first
    ones with names similar to it, are cut, and the number of tasks.  Each lane of the first meets
    each lane of the second in a cell, so neither a hot name nor its neighbours are one task."""
    n = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one, two = (named.select("blk", F.col("n_name").alias(f"name{no}"), F.col("n").cast("double").alias(f"n{no}")) for no in (1, 2))
    sized = materialize(near.join(one, ["blk", "name1"]).groupBy("blk", "name2").agg(F.sum("n1").alias("n1")).join(two, ["blk", "name2"]))
    pairs = sized.agg(F.sum(F.col("n1") * F.col("n2"))).first()[0] or 0.0
    size = min(max((pairs / (2 * n)) ** 0.5, LEAST_CELL), MOST_CELL)
    cuts = sized.select("blk", "name2", *(F.ceil(F.col(f"n{no}") / size).alias(f"cut{no}") for no in (1, 2)))
    return cuts, max(n, min(4 * n, int(pairs // TASK_PAIRS)))


def _dealt_pairs(near: DataFrame, cells: tuple[DataFrame, int], sig: DataFrame, sig_id: Column, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The pairs within ``sig`` for :func:`_pairs_scored`.  One shuffle deals the signatures, as the second
    of a pair by their name and as the first by each similar name; their ids and keys are made
    behind it, and the pairs from the two sides of each key in a cell."""
    cuts, n = cells
    at, own = ["blk", "name2", "cell"], dict.fromkeys(["n_name", "n_price", "n_provider", "n_duration", *sig.columns])
    lane = {no: F.expr(f"pmod(xxhash64(n_name, n_price, n_provider, n_duration), cut{no})") for no in (1, 2)}
    cell = {1: F.transform(F.expr("sequence(0L, cut2 - 1)"), lambda k: lane[1] * F.col("cut2") + k),
            2: F.transform(F.expr("sequence(0L, cut1 - 1)"), lambda k: k * F.col("cut2") + lane[2])}
    met = {1: near.join(cuts, ["blk", "name2"]).withColumnRenamed("name1", "n_name"),
           2: cuts.select("*", F.col("name2").alias("n_name"), F.lit(None).cast("double").alias("name_sim"))}
    sides = [_blocks(sig, threshold).join(met[no], ["blk", "n_name"]).select(
        "blk", "name2", F.explode(cell[no]).alias("cell"), F.lit(no).alias("no"), "name_sim", *own) for no in (1, 2)]
    dealt = sides[0].unionByName(sides[1]).repartition(n, *at).withColumn("sig_id", sig_id)
    row = F.struct(F.col("sig_id").alias("s"), F.col("n_name").alias("name"), F.col("n_price").alias("price"), F.col("n_provider").alias("provider"),
                   F.col("n_duration").alias("duration"), _price_value(F.col("n_price")).alias("value"), "name_sim")

    def pairs(texts: bool) -> DataFrame:
        keys = F.when(F.col("no") == 1, _keys(threshold, texts, False)).otherwise(_keys(threshold, texts, True))
        # outer, as a test for keys would go before the shuffle, which then could not serve both turns
        rows = dealt.select(*at, "no", row.alias("row"), F.explode_outer(keys).alias("k")).filter(F.col("k").isNotNull())
        rows = rows.groupBy(*at, "k").agg(*(F.collect_list(F.when(F.col("no") == no, F.col("row"))).alias(f"rows{no}") for no in (1, 2)))
        rows = rows.select("blk", "name2", "k", F.explode("rows1").alias("row1"), "rows2")
        rows = rows.select("blk", "name2", "k", "row1", F.explode("rows2").alias("row2"))
        return rows.select("blk", "name2", "k", "row1.name_sim", F.col("row1.name").alias("name1"), *(
            F.col(f"row{no}.{c}").alias(f"{c}{no}") for no in (1, 2) for c in ("s", "price", "provider", "duration", "value")))

    return pairs(False), pairs(True)


def pair_scores(sig: DataFrame, threshold: float, sig_id: Column | None = None) -> DataFrame:
    """Scores of candidate signature pairs (each unordered pair once, and each signature
    with itself).

    ``sig``: (sig_id, n_name, n_price, n_provider, n_duration), without the id if ``sig_id`` gives it as an
    expression over the others, which then takes no room in a shuffle.  Candidates share a
    block (the normalised provider; below 0.8 also the duration; down from 0.7 all names) and have names similar enough to reach the
    threshold (:func:`name_bound`); the name similarity is computed once per name pair of a
    block, so signatures are paired only through similar names.  Thresholds go from 0.5 to 1.
    """
    if threshold < 0.5:
        raise ValueError("thresholds go from 0.5 to 1")
    once = (F.col("name1") < F.col("name2")) | (F.col("s1") <= F.col("s2"))
    named = block_names(sig, threshold)
    near, alike = name_candidates(sig, threshold, named=named), alike_names(sig, threshold)
    near = near if alike is None else near.unionByName(alike)
    numbers, texts = _dealt_pairs(near, _cells(near, named), sig, F.col("sig_id") if sig_id is None else sig_id, threshold)
    return _pairs_scored(numbers, texts, threshold, once)


# ------------------------------------------------------------ greedy leaders
def signature_id(*cols: str) -> Column:
    """256-bit digest of the columns; nulls differ from empty texts."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def leader_signatures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sig_id, first): the signatures whose first row is a leader.

    ``nodes``: (sig_id, first), the place of a signature's first row in processing order;
    ``edges``: (s1, s2), each similar pair of two signatures once.  A signature is a leader
    unless a leader before it is similar.
    """
    x, y = nodes.alias("x"), nodes.alias("y")
    earlier = F.col("x.first") < F.col("y.first")
    return _undominated(nodes, materialize(
        edges.join(x, F.col("s1") == F.col("x.sig_id")).join(y, F.col("s2") == F.col("y.sig_id"))
        .select(F.when(earlier, F.col("s1")).otherwise(F.col("s2")).alias("a"),
                F.when(earlier, F.col("s2")).otherwise(F.col("s1")).alias("b"))))


def _undominated(nodes: DataFrame, open_: DataFrame) -> DataFrame:
    """The ``nodes`` that lead, given the edges ``open_`` (a, b) from the earlier to the later one.
    Each round the signatures no open edge points to are leaders, those they point to are not, and
    the edges of both leave the table, so a round reads only what is still open."""
    followers = nodes.select("sig_id").limit(0)
    while not open_.isEmpty():
        pointed = open_.select(F.col("b").alias("a")).distinct()
        told = materialize(open_.join(pointed, "a", "left_anti").select("b").distinct())
        followers = followers.unionAll(told)
        open_ = materialize(open_.join(pointed, "a", "left_semi").join(told, "b", "left_anti")
                            .join(told.select(F.col("b").alias("a")), "a", "left_anti"))
    return nodes.join(followers, "sig_id", "left_anti")


#: Signatures of the first stretch of :func:`greedy_leaders`, and rows (similar name pairs, links)
#: that a later one may hold.
FIRST_STRETCH, STRETCH_LINKS = 4096, 1 << 22


def greedy_leaders(sigs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(sig_id) of the leading signatures, and (sig_id, met): each follower with its first leader.

    ``sigs`` as in :func:`pair_scores`, ``sig_id`` a number in processing order.  The links of all
    signatures are never stored, nor the similar pairs of more than a few names: the order is taken in stretches, each decided
    by the links within it; then what is similar to its leaders leaves the table, and pairs with them
    are reduced to one row a signature where they are made.  The denser the links, the fewer signatures
    are left; the sparser, the longer the next stretch."""
    alike = alike_names(sigs, threshold)
    # a few names that many signatures share are paired once, not in each stretch
    named = _blocks(sigs, threshold).groupBy("blk").agg(F.count_distinct("n_name").alias("n"))
    n_pairs = named.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    whole = _both_ways(name_candidates(sigs, threshold)) if n_pairs <= STRETCH_LINKS else None
    later = F.col("s1") < F.col("s2")

    def links(near: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
        near = near if alike is None else near.unionByName(_both_ways(alike))
        return _scored(near, first, second, threshold, later).filter(F.col("score") >= threshold).select("s1", "s2")

    def first_met(found: DataFrame) -> DataFrame:
        return materialize(found.groupBy(F.col("s2").alias("sig_id")).agg(F.min("s1").alias("met")))

    heads, met, open_ = [], [], sigs
    left, stretch = sigs.count(), FIRST_STRETCH
    while left:
        # any beginning of the order is a stretch, so its end may be approximate
        end = None
        if left > stretch:
            end = open_.agg(F.percentile_approx("sig_id", stretch / left, 10000)).first()[0]
        part = open_ if end is None else open_.filter(F.col("sig_id") <= end)
        near = _both_ways(name_candidates(part, threshold)) if whole is None else whole
        inside = materialize(links(near, part, part))
        lead = materialize(_undominated(part.select("sig_id"), inside.toDF("a", "b")))
        heads.append(lead)
        met.append(first_met(inside.join(lead.select(F.col("sig_id").alias("s1")), "s1")))
        if end is None:
            break
        rest, leaders = open_.filter(F.col("sig_id") > end), part.join(lead, "sig_id")
        far = name_candidates(leaders, threshold, rest) if whole is None else whole
        met.append(first_met(links(far, leaders, rest)))
        open_ = materialize(rest.join(met[-1].select("sig_id"), "sig_id", "left_anti"))
        left = open_.count()
        # as many rows a pair as in this stretch, or fewer; those with the rest grow with the stretch alone
        within, beyond = (inside.count(), 0) if whole is not None else (max(inside.count(), near.count()), far.count())
        grown = min(4.0, (STRETCH_LINKS / max(within, 1)) ** 0.5, STRETCH_LINKS / max(beyond, 1))
        stretch = max(FIRST_STRETCH, int(stretch * grown))

    def all_of(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
        for part in parts:
            empty = empty.unionByName(part)
        return empty

    none = sigs.select("sig_id").limit(0)
    return all_of(heads, none), all_of(met, none.withColumn("met", F.col("sig_id")))


def dedup_leaders(products: DataFrame, threshold: float = K.SIMILARITY_THRESHOLD) -> DataFrame:
    """(row_id, is_leader, leader_id) for every well-formed row.  Malformed rows are
    dropped, as in the original.

    Rows of one signature have the same similar signatures, so the first leader that a row can
    meet is always a first row: of a similar signature, or of its own if that is similar to
    itself.  A row before that leader is one itself, a row after it follows it; so the greedy
    order is decided between signatures and rows are never joined with rows.
    """
    from pricesieve.operators.explore import running_totals
    if threshold < 0.5:
        raise ValueError("thresholds go from 0.5 to 1")
    ensure_checkpoint_dir(products.sparkSession)
    p = _ord(prepare(products))
    sig_cols = ["n_name", "n_price", "n_provider", "n_duration"]
    p = materialize(p.withColumn("sig", signature_id(*sig_cols)).select("row_id", "ord", "sig", *sig_cols))
    sigs = p.groupBy("sig", *sig_cols).agg(F.min("ord").alias("first"))
    # signatures are numbered in processing order
    sigs = materialize(running_totals(sigs, F.struct("n_name", "sig").desc(), {"sig_id": F.lit(1)}, lead=F.col("first")))
    heads, met = greedy_leaders(sigs.select("sig_id", *sig_cols), threshold)
    own = heads.join(sigs, "sig_id").filter(_self_score() >= threshold).select("sig_id", F.col("sig_id").alias("met"))
    firsts = sigs.select(F.col("sig_id").alias("met"), "first")
    least = met.unionByName(own).join(firsts, "met").join(sigs.select("sig_id", "sig"), "sig_id").select("sig", F.col("first").alias("met"))
    out = p.select("row_id", "ord", "sig").join(least, "sig", "left")
    leads = F.col("met").isNull() | (F.col("ord") <= F.col("met"))
    return out.select("row_id", leads.alias("is_leader"), F.when(leads, F.col("row_id")).otherwise(F.col("met.r")).alias("leader_id"))


def _self_score() -> Column:
    """The score of a signature with itself: every term it has is full."""
    def term(has: Column, weight: float) -> Column:
        return F.when(has, F.lit(weight)).otherwise(F.lit(0.0))

    return (term(F.col("n_name") != "", K.W_NAME) + term(F.coalesce(F.col("n_price") != "", F.lit(False)), K.W_PRICE)
            + term(F.col("n_provider").isNotNull(), K.W_PROVIDER) + term(F.col("n_duration") != "", K.W_DURATION))


def deduplicate(products: DataFrame, threshold: float = K.SIMILARITY_THRESHOLD) -> DataFrame:
    """The kept rows with their cluster size (duplicate_count, the leader included)."""
    m = dedup_leaders(products, threshold)
    sizes = m.groupBy("leader_id").agg(F.count(F.lit(1)).alias("duplicate_count"))
    kept = products.join(m.filter("is_leader").select("row_id"), "row_id")
    return kept.join(sizes.withColumnRenamed("leader_id", "row_id"), "row_id")
