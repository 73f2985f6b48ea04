"""Fuzzy line dedup: SimHash blocks of normalised lines as join keys, edit similarity, connected groups.

A line's normal form is its lower-cased words joined by one space. Lines of equal form are one node. Two nodes are
linked if their word sequences have an edit similarity of at least `similarity_pct` percent; words of any length count.

A line's SimHash has blocks of 64 bits. Each bit of a block is the sign of a weighted vote of the hashes of the line's word
shingles. Weights halve from one shingle to the next in the order of their hashes, and a block leaves out the shingles that
decided the blocks before it: so the heaviest one left outvotes all others together, and the block's bits are its hash.
Edits then change whole blocks instead of scattered bits, and by the pigeonhole principle lines whose edits leave one of
the blocks alone share a join key. There are as many blocks as leave a pair at the limit of similarity without a
common one with probability MISS (lines with fewer shingles have a block for each). Of a line of few words one more than its
edits can change are enough: the first shingle that two alike lines have in common is among those of either, so none is missed.

A key's bucket of two nodes is a pair. In a larger one all nodes are compared with its most frequent line; then with
PIVOTS of the nodes that are still outside that line's group; then what is still apart, pair by pair among
lines of near lengths or, in a bucket of more than CROWD, among lines with a rare pair of words in common: an edit changes two word pairs at most, so in any order of word pairs the first that alike lines have in common is
among the first of either, one more than their edits can change. The order puts word pairs last that a sample of the lines has
often, so lines that only share a passage don't meet. Pairs are left out before the edit check only if their lengths or
the parities of their words rule the similarity out. So no pair with a common key is lost, and neither the pairs of a connected
crowd nor those of lines around one passage are listed.
The first line of each connected group (by document id, then line number) is kept.

Only DataFrame functions are used. Edits are counted on strings of one character a word; where two words of a pair
share a character, the pair is counted again with characters of its own for each word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, forget, more_components, positional, written

MISS = 5e-4  # probability that a pair at the limit of similarity has no common block
SHINGLE = 3  # words, fewer where the similarity allows closer edits
PIVOTS = 8  # of the nodes of a bucket that its most frequent line has left open
CROWD = 1024  # lines of a key beyond which its nodes aren't compared with each other
SAMPLED, OFTEN, KNOWN = 4, 4, 1 << 16  # one line of so many tells which word pairs are frequent, those seen so often there; so many are told apart at most
FEW = 100_000  # ids of lines that are sent to all executors rather than moving all texts to them
SPACE = r"[\x20\x09-\x0D]+"
PLANES = 1 << 20  # characters that stand for words: those from 0x10000 on
SIGHTS, SUMS = 4, 2  # numbers in a sketch of a line that hold parities, and that hold four sums of 16 bits
SKETCH = ["n", *[f"s{i}" for i in range(SIGHTS + SUMS)]]  # its columns


def normal_form(line: Column) -> Column:
    """Lower-cased words joined by one space; empty for a line without words."""
    usual = F.lower(F.trim(line))
    odd = F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), "^ | $", "")
    uneven = F.contains(line, F.lit("  "))
    for c in "\t\n\v\f\r":
        uneven = uneven | F.contains(line, F.lit(c))
    return F.when(uneven, odd).otherwise(usual)


def _least_words(pct: int) -> int:
    """Words of the shortest lines in which an edit is allowed (one fewer at most)."""
    return 100 // max(1, 100 - pct) - 1


def block_plan(pct: int) -> tuple[int, int]:
    """(words of a shingle, blocks of a line). Of n words pct percent stay, in runs that an edit parts: each edit changes k shingles at most."""
    k = max(1, min(SHINGLE, math.ceil((math.ceil(100 / max(1, 100 - pct)) - 1) / 2)))
    same = min(0.99, max(0.1, 1 - k * (100 - pct) / 100))
    return k, math.ceil(math.log(MISS) / math.log(1 - same / (2 - same)))


def simhash_blocks(hashes: str, pct: int) -> Column:
    """The blocks of a line's SimHash, from the hashes of its words: the hashes of its heaviest shingles."""
    k, most = block_plan(pct)
    shingles = hashes  # of one word; each turn joins a run with the one a word later
    for _ in range(k - 1):
        shingles = f"transform(array({shingles}), s -> zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (x, y) -> xxhash64(x, y)))[0]"
    # Where the smallest values repeat, the heaviest are looked for among all.
    return F.expr(f"transform(transform(array(sort_array({shingles})), s -> named_struct('s', s, 'd', array_distinct(slice(s, 1, {most + 2})))), x -> slice(if(size(x.d) >= least({most}, size(x.s)), x.d, array_distinct(x.s)), 1, {most}))[0]")


def with_blocks(lines: DataFrame, hashes: str, pct: int) -> DataFrame:
    """lines with blocks: simhash_blocks of the hashes of their words (null: null), in steps that are columns of their own.

    Inside a lambda function nothing is compiled, and each value sorted is an object.
    """
    k, most = block_plan(pct)
    out, shingles = lines, hashes
    for i in range(k - 1):  # of one word; each turn joins a run with the one a word later, and the last is without one
        out = out.withColumn(f"wb_{i}", F.expr(f"zip_with({shingles}, slice({shingles}, 2, size({shingles}) - 1), (x, y) -> xxhash64(x, y))"))
        shingles = f"wb_{i}"
    out = out.withColumn("wb_all", F.expr(f"sort_array(slice({shingles}, 1, size({shingles}) - {k - 1}))"))
    out = out.withColumn("wb_least", F.expr(f"array_distinct(slice(wb_all, 1, {most + 2}))"))
    blocks = F.expr(f"slice(if(size(wb_least) >= least({most}, size(wb_all)), wb_least, array_distinct(wb_all)), 1, {most})")
    return out.withColumn("blocks", blocks).drop("wb_all", "wb_least", *[f"wb_{i}" for i in range(k - 1)])


def sufficient_blocks(pct: int) -> Column:
    """The blocks by which lines of n words meet: all, or where that is less, one more than the shingles that the edits of an alike pair change.

    Edits leave no more than that out of either line, so the smallest shingle in common is among the first so many of both.
    """
    return F.expr(f"slice(blocks, 1, cast({block_plan(pct)[0]} * (({100 - pct} * n) div {max(1, pct)}) + 1 as int))")


def _parities(hashes: str) -> str:
    """Which of 64 bits an odd number of words has: an edit changes two at most."""
    return f"aggregate({hashes}, 0L, (p, x) -> p ^ shiftleft(1L, cast(x & 63 as int)))"


def _sights(texts: DataFrame) -> DataFrame:
    """node and SKETCH of texts (node, f): the number of words, their parities in SIGHTS parts, and for 4 SUMS bits the number of words
    whose hash has them. A row for each word is dropped as soon as it is counted; inside a lambda function nothing is compiled."""
    words = texts.select("node", F.explode(F.split("f", " ")).alias("w")).select("node", F.xxhash64("w").alias("x"))
    ones = sum(1 << 16 * i for i in range(4))
    parities = [F.expr(f"bit_xor(if(shiftrightunsigned(x, 6) & {SIGHTS - 1} = {i}, shiftleft(1L, cast(x & 63 as int)), 0L))") for i in range(SIGHTS)]
    sums = [F.expr(f"coalesce(try_sum(shiftrightunsigned(x, {10 + i}) & {ones}L), 0L)") for i in range(SUMS)]
    return words.groupBy("node").agg(*[c.alias(name) for c, name in zip([F.count(F.lit(1)).cast("int"), *parities, *sums], SKETCH)])


def _may_be_alike(a: str, b: str, pct: int) -> Column:
    """Whether two lines' lengths and sketches leave it open that they are alike: an edit changes two parities at most, and each sum by one.

    Sums of lines beyond 32,767 words run over and say nothing.
    """
    edits = f"cast(({100 - pct} * greatest({a}_n, {b}_n)) div 100 as int)"
    apart = " + ".join(f"bit_count({a}_s{i} ^ {b}_s{i})" for i in range(SIGHTS))
    lane = lambda s, k, i: f"(shiftrightunsigned({s}_s{SIGHTS + k}, {16 * i}) & 65535L)"
    sums = " and ".join(f"abs({lane(a, k, i)} - {lane(b, k, i)}) <= {edits}" for k in range(SUMS) for i in range(4))
    return F.expr(f"100 * least({a}_n, {b}_n) >= {pct} * greatest({a}_n, {b}_n) and {apart} <= 2 * {edits} and (greatest({a}_n, {b}_n) > 32767 or ({sums}))")


def _characters(words: str) -> str:
    """One character a word; different words share one of PLANES with that probability."""
    return f"decode(unhex(array_join(transform({words}, w -> lpad(hex(65536 + pmod(xxhash64(w), {PLANES})), 8, '0')), '')), 'UTF-32')"


def _most(pct: int) -> str:
    """The edits that a pair of a_n and b_n words may differ in."""
    return f"cast(({100 - pct} * greatest(a_n, b_n)) div 100 as int)"


def _texts_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of texts of some nodes (node, each once). All texts are moved only if the nodes are more than FEW."""
    nodes = written(nodes, "wanted-lines")
    return texts.join(F.broadcast(nodes) if nodes.count() <= FEW else nodes, "node", "left_semi")


def alike(pairs: DataFrame, texts: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) of nodes whose word sequences are similar enough. texts: node and f (the normal form)."""
    pairs = written(pairs, "near-pairs")
    named = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts).withColumn("w", F.split("f", " "))
    texts = written(named.select("node", "f", F.size("w").alias("n"), F.expr(_characters("w")).alias("c")), "line-characters")
    t = lambda s: texts.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("f", "n", "c")])
    both = pairs.join(t("a"), "a").join(t("b"), "b").filter(f"100 * least(a_n, b_n) >= {pct} * greatest(a_n, b_n)")
    # Words that share a character can only bring lines nearer: those that pass are looked at once more.
    near = both.filter(F.expr(f"levenshtein(a_c, b_c, {_most(pct)}) >= 0"))
    distinct = F.size(F.array_distinct(F.concat(F.split("a_f", " "), F.split("b_f", " "))))
    codes = F.size(F.expr("array_distinct(concat(split(a_c, ''), split(b_c, '')))"))
    near = written(near.select("a", "b", "a_n", "b_n", (distinct == codes).alias("sure"), F.expr("if(sure, null, a_f)").alias("a_f"), F.expr("if(sure, null, b_f)").alias("b_f")), "near-lines")
    forget(pairs, texts)
    return near.filter("sure").select("a", "b").union(_exactly_alike(near.filter("not sure"), pct))


def _exactly_alike(pairs: DataFrame, pct: int) -> DataFrame:
    """The same with a character of its own for each word of a pair: its rank in the pair's sorted distinct words."""
    word = lambda s, i: F.posexplode(F.split(f"{s}_f", " ")).alias("at", "w")
    sides = [pairs.select("a", "b", "a_n", "b_n", F.lit(i).alias("side"), word(s, i)) for i, s in enumerate("ab")]
    words = sides[0].union(sides[1])
    # A group is one pair's words, at most those of two lines.
    ranks = words.select("a", "b", "w").distinct().groupBy("a", "b").agg(F.sort_array(F.collect_list("w")).alias("all"))
    ranks = ranks.select("a", "b", F.posexplode("all").alias("rank", "w"))
    code = F.expr("decode(unhex(lpad(hex(if(rank < 55000, 256 + rank, 10536 + rank)), 8, '0')), 'UTF-32')")
    lines = words.join(ranks, ["a", "b", "w"]).groupBy("a", "b", "a_n", "b_n", "side").agg(F.sort_array(F.collect_list(F.struct("at", code.alias("c")))).alias("cs"))
    lines = lines.withColumn("line", F.expr("array_join(transform(cs, x -> x.c), '')"))
    both = lines.groupBy("a", "b", "a_n", "b_n").agg(F.max(F.when(F.col("side") == 0, F.col("line"))).alias("a_c"), F.max(F.when(F.col("side") == 1, F.col("line"))).alias("b_c"))
    return both.filter(F.expr(f"levenshtein(a_c, b_c, {_most(pct)}) >= 0")).select("a", "b")


def _line_table(df: DataFrame, pct: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(lines, nodes). lines: ld_at (a number of the row), ld_id, ld_row (a hash of id and text), ln, node, check, n, p and blocks, for
    each line with a word and for each row's first line (node is null if that has no word; p and blocks are null in lines too
    short for edits). nodes: node, check, n, times and p of each normal form, and one line that has it (ld_id, ld_row, ln)."""
    # Rows are numbered before they are split, so that equal rows aren't counted together.
    rows = df.select(F.monotonically_increasing_id().alias("ld_at"), F.col(id_col).cast("long").alias("ld_id"), F.xxhash64(F.col(id_col), F.col(text)).alias("ld_row"), F.col(text).alias("ld_text"))
    split = rows.select("ld_at", "ld_id", "ld_row", F.posexplode_outer(F.split("ld_text", "\n")).alias("ln", "line"))
    some = split.select("ld_at", "ld_id", "ld_row", F.coalesce("ln", F.lit(0)).alias("ln"), "line").filter("trim(line) <> '' or ln = 0")
    form = some.withColumn("f", normal_form(F.col("line"))).drop("line")
    word = F.col("f") != ""
    hashed = form.select("ld_at", "ld_id", "ld_row", "ln", F.when(word, F.xxhash64("f")).alias("node"), F.when(word, F.xxhash64(F.lit(1), "f")).alias("check"), F.when(word, F.split("f", " ")).alias("w"))
    hashed = hashed.withColumn("n", F.size("w"))
    long_ = F.col("n") >= max(block_plan(pct)[0], _least_words(pct))
    hashed = hashed.withColumn("h", F.when(long_, F.expr("transform(w, x -> xxhash64(x))"))).drop("w")
    keyed = with_blocks(hashed.withColumn("p", F.when(long_, F.expr(_parities("h")))), "h", pct)
    keyed = written(keyed.drop("h").withColumn("blocks", sufficient_blocks(pct)), "line-keys")
    # Any of equal lines stands for all: all columns are the first row's.
    nodes = keyed.filter("node is not null").groupBy("node", "check", "n").agg(F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in ("p", "ld_id", "ld_row", "ln")])
    return keyed, written(nodes, "line-nodes")


def _groups_of_lines(df: DataFrame, lines: DataFrame, nodes: DataFrame, pct: int, id_col: str, text: str) -> DataFrame:
    """(node, label) of the nodes that are linked with others."""
    # Most keys occur once, so nothing is gained by counting them before they are dealt out.
    # The join below leaves out null keys; done before, both its sides and the counts read one exchange.
    bands = lines.filter("blocks is not null").select("node", F.explode("blocks").alias("key")).filter("key is not null").repartition("key")
    buckets = bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), (F.count(F.lit(1)) > CROWD).alias("many")).filter("lo <> hi").select("key", "many")
    kept = bands.join(buckets.hint("shuffle_hash"), "key").distinct()
    members = written(kept.join(nodes.select("node", "times", F.struct("n", "p").alias("sketch")), "node"), "members")
    longer = F.greatest("a_sketch.n", "b_sketch.n")
    near = 100 * F.least("a_sketch.n", "b_sketch.n") >= pct * longer
    near = near & (F.bit_count(F.col("a_sketch.p").bitwiseXOR(F.col("b_sketch.p"))) <= 2 * F.floor((100 - pct) * longer / 100))
    # Nodes that could be alike with none of their bucket leave it; in a crowd that would compare all with all.
    few = members.filter("not many")
    other = few.select(F.col("key").alias("b_key"), F.col("node").alias("b"), F.col("sketch").alias("b_sketch"))
    met = few.withColumn("a_sketch", F.col("sketch")).join(other, (F.col("key") == F.col("b_key")) & (F.col("node") != F.col("b")) & near, "left_semi").drop("a_sketch")
    met = written(met.union(members.filter("many")).drop("many"), "met")
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("a"), F.max("node").alias("b"))
    couples = sizes.filter("size = 2").select("a", "b")
    large = met.join(sizes.filter("size > 2").select("key", "size"), "key")
    side = lambda d, s, *more: d.select("key", F.col("node").alias(s), F.col("sketch").alias(f"{s}_sketch"), *more)
    chosen = large.groupBy("key").agg(F.max(F.struct("times", "node", "sketch")).alias("p")).select("key", F.col("p.node").alias("a"), F.col("p.sketch").alias("a_sketch"))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    often = written(chosen, "pivots")
    star = side(large, "b").join(often, "key").filter("a <> b").filter(near).select(*ordered)
    pairs = written(couples.union(star).distinct(), "line-pairs")
    forget(members)

    # The texts of all lines that may be compared, fetched once.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")).distinct()
    places = nodes.join(wanted, "node", "left_semi").select("node", "ld_id", "ld_row", "ln")
    by_row = places.groupBy("ld_id", "ld_row").agg(F.collect_list(F.struct("node", "ln")).alias("at"))  # a document's own lines
    own = df.select(F.col(id_col).cast("long").alias("d_id"), F.xxhash64(F.col(id_col), F.col(text)).alias("d_row"), F.col(text).alias("d_text"))
    found = own.join(by_row, F.col("d_id").eqNullSafe(F.col("ld_id")) & (F.col("d_row") == F.col("ld_row")))
    # A row for each line, without the document's other lines.
    found = found.select(F.explode(F.expr(r"transform(array(split(d_text, '\n')), s -> transform(at, x -> named_struct('node', x.node, 'line', s[x.ln])))[0]")).alias("x"))
    found = found.select("x.node", normal_form(F.col("x.line")).alias("f"))
    # Only rows that occur several times give a line's text several times.
    again = lines.select("ld_id", "ld_row", "ld_at").distinct().groupBy("ld_id", "ld_row").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    found = found.dropDuplicates(["node"]) if again.head(1) else found
    texts = written(found, "line-texts")
    sights = written(_sights(texts), "line-sights")
    near = _may_be_alike("a", "b", pct)
    groups = components(alike(pairs.join(_side(sights, "a"), "a").join(_side(sights, "b"), "b").filter(near).select("a", "b"), texts, pct))
    if not large.head(1):
        return groups
    # A key without an open node gives no pair, now or later: groups only grow.
    every = _labelled(large.select("key", "node", "size"), often, groups)
    open_ = F.col("group") != F.col("main")
    labelled = written(every.join(every.filter(open_).select("key").distinct(), "key", "left_semi").join(sights, "node"), "crowds")
    forget(met, every, sights)
    drawn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("group"), "node"))
    a = _side(labelled.filter(open_).withColumn("drawn", drawn).filter(F.col("drawn") <= PIVOTS), "a", "key", "group")
    more = written(alike(a.join(_side(labelled, "b", "key", "group"), "key").filter("a_group <> b_group").filter(near).select(*ordered).distinct(), texts, pct), "line-links")
    if more.head(1):
        groups = more_components(groups, more)
        labelled = _labelled(labelled.drop("group", "main"), often, groups)
    links = alike(_near_pairs(labelled.filter(F.col("size") <= CROWD), pct), texts, pct)
    if (crowded := labelled.filter(F.col("size") > CROWD)).head(1):
        rare, own = _rare_pairs(crowded, texts, pct)
        links = links.union(alike(rare, own, pct))
    more = written(links, "line-links")
    return more_components(groups, more) if more.head(1) else groups


def _side(lines: DataFrame, s: str, on: str | None = None, *more: str) -> DataFrame:
    """node as s and SKETCH and more with s before their names, for one side of pairs that meet on a column."""
    return lines.select(*([on] if on else []), F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in (*SKETCH, *more)])


def _labelled(large: DataFrame, often: DataFrame, groups: DataFrame) -> DataFrame:
    """large (key, node and more) with group, the node's, and main, that of the key's most frequent line (often: key and a)."""
    named = groups.select(F.col("node").alias("g_node"), "label")
    labelled = large.join(named, F.col("node") == F.col("g_node"), "left").select(*large.columns, F.coalesce("label", "node").alias("group"))
    main = often.join(named, F.col("a") == F.col("g_node"), "left").select("key", F.coalesce("label", "a").alias("main"))
    return written(labelled.join(main, "key"), "labelled")


def _open_pairs(a: DataFrame, b: DataFrame, on: list[str], pct: int) -> DataFrame:
    """The pairs of two sides, a with open nodes only, that are of different groups and may be alike. Two that are both open meet from either side."""
    met = a.join(b, on).filter((~F.col("b_open") | (F.col("a") < F.col("b"))) & (F.col("a_group") != F.col("b_group")) & _may_be_alike("a", "b", pct))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _near_pairs(labelled: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) that may be alike, of nodes of different groups that share a key and of which one is outside the key's main group.
    labelled: as _labelled gives it. Lines of near lengths are of one class or of two that are next to each other.
    """
    step = math.log(100 / max(1, min(99, pct)))
    near = labelled.withColumn("open", F.col("group") != F.col("main")).withColumn("class", F.floor(F.log("n") / step).cast("int"))
    a = _side(near.filter("open").withColumn("class", F.explode(F.array(*[F.col("class") + i for i in (-1, 0, 1)]))), "a", "key", "group", "class").withColumnRenamed("a_class", "class")
    b = _side(near, "b", "key", "group", "open", "class").withColumnRenamed("b_class", "class")
    return _open_pairs(a, b, ["key", "class"], pct)


def _rare_pairs(labelled: DataFrame, texts: DataFrame, pct: int) -> tuple[DataFrame, DataFrame]:
    """The same for large buckets: all pairs that are alike are among them. And the texts (node, n, f) of these buckets' lines."""
    keys = labelled.filter("group <> main").select("key").distinct()
    crowd = labelled.join(keys, "key", "left_semi").groupBy("node").agg(F.max(F.col("group") != F.col("main")).alias("open"), *[F.first(c).alias(c) for c in ("group", *SKETCH)])
    crowd = written(crowd, "crowd-lines")
    own = written(_texts_of(crowd.select("node"), texts).select("node", F.size(F.split("f", " ")).alias("n"), "f"), "crowd-texts")
    # Dealt out by lines before they are words, so that a line's words stay together.
    k = min(2, block_plan(pct)[0])
    lines = own.repartition("node")
    spread = lines.withColumn("w", F.split("f", " ")).select("node", "n", "w", F.posexplode("w").alias("at", "x")).filter(f"at <= n - {k}")
    grams = spread.select("node", "n", F.expr("xxhash64(x, get(w, at + 1))" if k == 2 else "xxhash64(x)").alias("gram"))
    sample = grams.filter(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(SAMPLED)) == 0)
    # Any order is right; one that knows fewer frequent word pairs only lets more lines meet.
    often = sample.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= OFTEN).orderBy(F.desc("times"), "gram").limit(KNOWN)
    ranked = grams.join(F.broadcast(written(often, "frequent")), "gram", "left")
    # One number says how often a word pair is seen and which it is.
    ranked = ranked.select("node", "n", F.expr("shiftleft(coalesce(floor(log2(times)), 0L), 57) | shiftrightunsigned(gram, 7)").alias("gram"))
    order = Window.partitionBy("node").orderBy("gram")
    ranked = ranked.select("node", "n", "gram", F.row_number().over(order).alias("place"), F.rank().over(order).alias("begin"))
    # A line of n words and any that it is alike with are so many edits apart at most. What a line has again is something else each time.
    first = ranked.filter(f"place <= {k} * (({100 - pct} * n) div {max(1, pct)}) + 1").select(F.xxhash64("gram", F.expr("place - begin")).alias("gram"), "node").repartition("gram")
    met = first.groupBy("gram").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("gram")
    first = written(first.join(met.hint("shuffle_hash"), "gram").join(crowd, "node"), "rare")
    return _open_pairs(_side(first.filter("open"), "a", "gram", "group"), _side(first, "b", "gram", "group", "open"), ["gram"], pct), own


def duplicate_lines(df: DataFrame, similarity_pct: int = 90, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(gone, lines). gone: ld_id, ld_row, ln of every line to remove; lines: as _line_table gives them.

    Lines without a word are never removed, nor are null texts. Null ids come after all others. Rows with equal ids are
    one document: their lines at one place don't remove each other. An empty table gives no rows; other columns play
    no part.
    """
    lines, nodes = _line_table(df, similarity_pct, id_col, text)
    groups = _groups_of_lines(df, lines, nodes, similarity_pct, id_col, text)
    known = nodes.join(groups, "node", "left").filter("times > 1 or label is not null").select("node", "check", F.coalesce("label", "node").alias("group"))
    found = written(lines.join(known, ["node", "check"]).select("ld_id", "ld_row", "ln", "group"), "line-places")
    kept = found.groupBy("group").agg(F.min(F.struct(F.col("ld_id").isNull().alias("none"), "ld_id", "ln")).alias("keep"))
    gone = found.join(kept, "group").filter(~(F.col("ld_id").eqNullSafe(F.col("keep.ld_id")) & (F.col("ln") == F.col("keep.ln"))))
    return gone.select("ld_id", "ld_row", "ln"), lines


def _by_row(gone: DataFrame) -> DataFrame:
    return gone.groupBy("ld_id", "ld_row").agg(F.sort_array(F.collect_set("ln")).alias("removed"))  # a document's own lines


def line_report(df: DataFrame, similarity_pct: int = 90, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_lines (with a word), n_removed and removed (line numbers from 0) for each row of df."""
    gone, lines = duplicate_lines(df, similarity_pct, id_col, text)
    rows = lines.groupBy("ld_at", "ld_id", "ld_row").agg(F.count("node").alias("n_lines"))
    g = _by_row(gone).select(F.col("ld_id").alias("g_id"), F.col("ld_row").alias("g_row"), "removed")
    joined = rows.join(g, F.col("ld_id").eqNullSafe(F.col("g_id")) & (F.col("ld_row") == F.col("g_row")), "left")
    removed = F.coalesce("removed", F.expr("cast(array() as array<int>)"))
    return joined.select(F.col("ld_id").alias(id_col), "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_duplicate_lines(df: DataFrame, similarity_pct: int = 90, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows and columns, each text without its removed lines; a text that loses all its lines becomes empty."""
    gone = _by_row(duplicate_lines(df, similarity_pct, id_col, text)[0])
    mine, names = positional(df)
    own = F.col(names[id_col]), F.col(names[text])
    joined = mine.withColumn("wd_row", F.xxhash64(*own)).join(gone, own[0].cast("long").eqNullSafe(F.col("ld_id")) & (F.col("wd_row") == F.col("ld_row")), "left")
    left = F.expr(f"array_join(filter(split({names[text]}, '\\n'), (x, i) -> not array_contains(removed, i)), '\\n')")
    return joined.select(*[(F.when(F.col("removed").isNull(), F.col(n)).otherwise(left) if c == text else F.col(n)).alias(c) for c, n in names.items()])
