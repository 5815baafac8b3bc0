r"""Near-duplicate lines by a segment-partition edit join (DataFrame functions only).

Two lines of at least MIN_CHARS characters are linked if their edit distance is at most
EDITS. A line is split into EDITS + 1 segments; if a line r (not the longer one) is within
EDITS of s, one segment of r occurs in s at one of few places that follow from the two
lengths and the segment's number. So each distinct line is indexed under its segments
(with its length and the segment's number) and probes, for each length from its own down
to EDITS shorter, only those places. Pairs that meet and whose letter counts do not rule
them out are verified by edit distance in a band of diagonals, kept in the bits of one
integer and moved one column at a time, after their common start is cut off.

Links are transitive, so a group of near copies is never expanded into its pairs. A segment
under which at most SMALL lines are indexed is joined with its probes: at most SMALL rows a
probe. The lines of a larger one meet one line drawn from it instead, and where all fall into
one component, no pair is left. Else the segment is cut out of its lines, and what remains
of them is segmented anew, since it has the same few edits: that parts lines which only look
alike. What is still large after LEVELS such cuts, or too short for another, is compared in
blocks of BLOCK lines, and a line gives one link for each component that it reaches in a
block. So all pairs that meet are verified or lie in one component.

Steps over tables that are counted as small run in one partition, without a shuffle.
Up to HERE links, by their count, are put into components in the driver.
Distinct lines move once, as their keys, and postings once; texts of pairs are fetched
for lines in a pair or in a large segment only. Lines carry a 64-bit hash as id. Of a
component of equal or linked lines the first, by doc_id and line number, stays in its
document.

Defined cases: null counts as empty; lines are parts between \n; a line of white space
only is neither linked nor removed; shorter lines than MIN_CHARS are removed only as exact
copies; rows with the same doc_id count as one document; further columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.graph import components
from glyphflow.plans.staging import Workspace, broadcast_if_small, one_partition

EDITS, MIN_CHARS = 2, 24
#: Lines under one segment that are joined with its probes; cuts for more, lines in a block, shortest text to cut.
SMALL, LEVELS, BLOCK, SHORTEST = 16, 4, 256, 12
#: Edges that are put together in the driver.
HERE = 1 << 16
_LETTERS = "aeinorstlu"
_BITS = 2 * EDITS + 4
_MASK = (1 << _BITS) - 1


def _segments(length: Column) -> list[tuple[Column, Column]]:
    """(start from 1, length) of each of the three segments of a line so long."""
    base, rest = F.floor(length / 3).cast("int"), (length % 3).cast("int")
    one, two = base, base + F.when(rest == 2, 1).otherwise(0)
    return [(F.lit(1), one), (one + 1, two), (one + two + 1, base + F.when(rest >= 1, 1).otherwise(0))]


def _places(less: int) -> list[tuple[int, int]]:
    """(number, shift) of the segments of a line shorter by so much, as they may lie in a line."""
    return [(k, shift) for k in range(1, EDITS + 2) for shift in range(max(1 - k, less - (EDITS + 1 - k)), min(k - 1, less + (EDITS + 1 - k)) + 1)]


#: (less, number, shift) of a line's postings: its own segments first.
LAYOUT = sorted(((less, *x) for less in range(EDITS + 1) for x in _places(less)), key=lambda x: (x[0] != 0 or x[2] != 0, x))


def postings(line: Column, length: Column) -> Column:
    """An array of keys in the order of LAYOUT."""
    # a part of the line around all places of one segment, since a substring costs the length of what it is cut from
    margin = 2 * EDITS
    parts = []
    for start, size in _segments(length):
        first = F.greatest(F.lit(1), start - margin)
        parts.append((first, F.substring(line, first, size + 3 * margin)))
    keys = []
    for less, number, shift in LAYOUT:
        of = length - less
        start, size = _segments(of)[number - 1]
        first, part = parts[number - 1]
        keys.append(F.xxhash64(of, F.lit(number), F.substring(part, start + shift - first + 1, size)))
    return F.array(*keys)


def _without(text: Column, length: Column, less: Column, number: Column, shift: Column) -> Column:
    """The text without the place of a segment."""
    segments = _segments(length - less)
    start, size = (F.when(number == 1, segments[0][k]).when(number == 2, segments[1][k]).otherwise(segments[2][k]) for k in (0, 1))
    return F.concat(F.substring(text, F.lit(1), start + shift - 1), F.substring(text, start + shift + size, length))


def _again(key: Column, rest: Column, less: Column) -> Column:
    """Postings of what remains of a line within its segment: (key, number, shift)."""
    length = F.length(rest)
    of = length - less
    every = F.lit(None).cast("array<struct<key:bigint,number:int,shift:int>>")
    for k in range(EDITS + 1):
        some = [F.struct(F.xxhash64(key, F.lit(number), F.substring(rest, _segments(of)[number - 1][0] + shift, _segments(of)[number - 1][1])).alias("key"), F.lit(number).alias("number"), F.lit(shift).alias("shift")) for number, shift in _places(k)]
        every = F.when(less == k, F.array(*some)).otherwise(every)
    return every


def letter_counts(line: Column) -> Column:
    """Counts of ten frequent letters modulo 4, as two bits each in Gray code."""
    total, left = F.lit(0), line
    for k, x in enumerate(_LETTERS):
        # what is left gets shorter with each letter
        fewer = F.replace(left, F.lit(x), F.lit(""))
        total = total.bitwiseOR(F.shiftleft((F.octet_length(left) - F.octet_length(fewer)).bitwiseAND(F.lit(3)), 2 * k))
        left = fewer
    # neighbours round the circle 0, 1, 2, 3 differ in one bit of the code
    return total.bitwiseXOR(F.shiftright(total, 1).bitwiseAND(F.lit(0x15555555)))


def _may_link(a: Column, b: Column) -> Column:
    """False if the letters' counts differ by more than two for each edit: round the circle, so never more than the true difference."""
    return F.bit_count(a.bitwiseXOR(b)) <= 2 * EDITS


def common_start(a: Column, b: Column) -> Column:
    """Length of the longest common start, by halving (up to 65535)."""

    def longer(k: Column, step: Column) -> Column:
        more = k + step
        return F.when((F.length(a) >= more) & (F.length(b) >= more) & (F.substring(a, k + 1, step) == F.substring(b, k + 1, step)), more).otherwise(k)

    return F.aggregate(F.array(*[F.lit(1 << x) for x in range(15, -1, -1)]), F.lit(0), longer)


def within_edits(a: Column, b: Column, edits: int = EDITS) -> Column:
    """True if the edit distance of a and b is at most edits.

    Bits of vp and vn hold the steps up and down between the rows of one column of the
    distance matrix, for a band of rows that moves down with each column; the top bit is
    the row edits below the diagonal. When that row reaches the end of a, the last row is
    followed to the end of b. A row above the band can only be larger than the bound.
    """
    bits, mask = 2 * edits + 4, (1 << (2 * edits + 4)) - 1
    top = 1 << (bits - 1)
    long = lambda x: F.lit(x).cast("long")

    def let(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def column(acc: Column, j: Column, at: Column, bt: Column, n: Column) -> Column:
        match = long(0)
        for bit in range(bits):
            i = j + (edits - (bits - 1 - bit))
            match = match.bitwiseOR(F.when((i >= 1) & (i <= n) & (F.get(at, i - 1) == F.get(bt, j - 1)), long(1 << bit)).otherwise(long(0)))

        def with_match(x: Column) -> Column:
            carry = (x.bitwiseAND(acc.vp) + acc.vp).bitwiseAND(long(mask))
            d0 = carry.bitwiseXOR(acc.vp).bitwiseOR(x).bitwiseOR(acc.vn)
            return let(d0, with_d0)

        def with_d0(d: Column) -> Column:
            hp = acc.vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(acc.vp)).bitwiseAND(long(mask)))
            hn = d.bitwiseAND(acc.vp)
            return let(F.struct(d.alias("d"), hp.alias("hp"), hn.alias("hn")), with_all)

        def with_all(s: Column) -> Column:
            down = F.shiftright(s.d, 1)
            sinking = j <= n - edits
            row = F.pow(F.lit(2.0), F.lit(float(bits - 1)) - (j - (n - edits))).cast("long")
            score = F.when(sinking, acc.score + F.when(s.d.bitwiseAND(long(top)) == 0, 1).otherwise(0)).otherwise(
                acc.score + F.when(s.hp.bitwiseAND(row) != 0, 1).otherwise(0) - F.when(s.hn.bitwiseAND(row) != 0, 1).otherwise(0)
            )
            vp = s.hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(s.hp)).bitwiseAND(long(mask)))
            return F.struct(vp.alias("vp"), down.bitwiseAND(s.hp).alias("vn"), score.cast("int").alias("score"))

        # once the score cannot come back within the bound, columns are only passed over
        return F.when(acc.score > 3 * edits, acc).otherwise(let(match, with_match))

    first = F.struct(long(mask ^ ((1 << (bits - edits - 1)) - 1)).alias("vp"), long(0).alias("vn"), F.lit(edits).alias("score"))

    def whole(s: Column) -> Column:
        n, m = F.size(s.at), F.size(s.bt)
        end = F.aggregate(F.sequence(F.lit(1), m), first, lambda acc, j: column(acc, j, s.at, s.bt, n))
        return F.when(F.abs(n - m) > edits, False).when(n <= edits, F.levenshtein(s.a, s.b) <= edits).when(m == 0, n <= edits).otherwise(end.score <= edits)

    # bound once, or the characters would be split anew for each column
    every = F.lit("(?s).")
    return let(F.struct(F.regexp_extract_all(a, every, F.lit(0)).alias("at"), F.regexp_extract_all(b, every, F.lit(0)).alias("bt"), a.alias("a"), b.alias("b")), whole)


def _with_letters(pairs: DataFrame, text: DataFrame) -> DataFrame:
    """The pairs (a, b) that letters allow."""
    side = lambda x: text.select(F.col("id").alias(f"i{x}"), F.col("letters").alias(f"letters_{x}"))
    return pairs.join(side("a"), F.col("a") == F.col("ia")).join(side("b"), F.col("b") == F.col("ib")).where(_may_link(F.col("letters_a"), F.col("letters_b"))).select("a", "b")


def _verified(ws: Workspace, pairs: DataFrame, text: DataFrame) -> DataFrame:
    """Those of pairs (a, b) which letters allow that are within EDITS."""
    side = lambda x, *names: text.select(F.col("id").alias(f"i{x}"), *(F.col(n).alias(f"{n}_{x}") for n in names))
    both = pairs.select("a", "b").join(side("a", "line"), F.col("a") == F.col("ia")).join(side("b", "line"), F.col("b") == F.col("ib"))
    both = both.select("a", "b", F.col("line_a").alias("la"), F.col("line_b").alias("lb"))
    if hasattr(text, "is_one"):  # joined in one task, compared in many
        both = both.repartition(4 * ws.spark.sparkContext.defaultParallelism, "a", "b")
    cut = both.select("a", "b", "la", "lb", common_start(F.col("la"), F.col("lb")).alias("k"))
    rest = ws.keep(cut.select("a", "b", F.expr("substring(la, k + 1)").alias("ra"), F.expr("substring(lb, k + 1)").alias("rb")))
    return ws.keep(rest.where(within_edits(F.col("ra"), F.col("rb"))).select("a", "b"))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _small_or_not(ws: Workspace, df: DataFrame) -> DataFrame:
    """Staged, as one partition if it is small with its texts."""
    return one_partition(ws.keep(df), "rest")


def _divided(ws: Workspace, members: DataFrame, comp: DataFrame) -> DataFrame:
    """The members under keys that have lines of several components, with their component."""
    its = broadcast_if_small(comp, 16).withColumnRenamed("id", "cid")
    labelled = members.join(its, F.col("id") == F.col("cid"), "left").withColumn("component", F.coalesce("component", "id")).drop("cid")
    several = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(F.col("key").alias("of"))
    return _small_or_not(ws, labelled.join(several, F.col("key") == F.col("of"), "left_semi"))


def _crowded(ws: Workspace, own: DataFrame) -> DataFrame:
    """The keys under which more than SMALL lines are indexed."""
    return ws.keep(own.groupBy("key").count().where(F.col("count") > SMALL).select(F.col("key").alias("of")))


def _large_groups(ws: Workspace, members: DataFrame, text: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of edges and of such further links that pairs under one key lie in one component or are not linked.

    members: key, id, less (by which lines indexed under the key are shorter), own (is it
    indexed), rest (its line without what the key stands for), letters.
    """
    comp = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)  # at first each line stands for itself
    for level in range(LEVELS + 1):
        members = _divided(ws, members, comp)
        if level and members.count() == 0:
            break
        draw = F.min(F.when(F.col("own"), F.struct(F.xxhash64(F.lit(level), "key", "id"), F.col("id").alias("lead"), F.col("component").alias("lead_component"), F.col("letters").alias("lead_letters")))).alias("draw")
        lead = members.groupBy("key").agg(draw).select(F.col("key").alias("of"), "draw.lead", "draw.lead_component", "draw.lead_letters")
        pairs = members.join(lead, F.col("key") == F.col("of")).where((F.col("component") != F.col("lead_component")) & _may_link(F.col("letters"), F.col("lead_letters"))).select(*_pair("id", "lead"))
        fits = (F.length("rest") - F.col("less") >= SHORTEST) & F.lit(level < LEVELS)
        late = members.where(~fits)
        more = members.where(fits).select("key", "id", "less", "own", "rest", "letters", "component", F.explode(_again(F.col("key"), F.col("rest"), F.col("less"))).alias("x"))
        more = _small_or_not(ws, more.select(F.col("x.key").alias("key"), "id", "less", (F.col("own") & (F.col("x.shift") == 0)).alias("own"), _without(F.col("rest"), F.length("rest"), F.col("less"), F.col("x.number"), F.col("x.shift")).alias("rest"), "letters", "component"))
        hot = broadcast_if_small(_crowded(ws, more.where("own")), 8)
        few = more.join(hot, F.col("key") == F.col("of"), "left_anti")
        own = few.where("own").select(F.col("key").alias("of"), F.col("id").alias("id2"), F.col("component").alias("component2"), F.col("letters").alias("letters2"))
        met = few.join(own, (F.col("key") == F.col("of")) & (F.col("component") != F.col("component2")) & _may_link(F.col("letters"), F.col("letters2"))).select(*_pair("id", "id2"))
        new = _verified(ws, one_partition(ws.keep(pairs.union(met))).distinct(), text)
        if late.limit(1).count():
            new = new.union(_in_blocks(late, text))
        edges = one_partition(ws.keep(edges.union(new)))
        comp = components(ws, edges, HERE)
        members = more.join(hot, F.col("key") == F.col("of"), "left_semi").drop("component").distinct()
    return comp


def _in_blocks(members: DataFrame, text: DataFrame) -> DataFrame:
    """Links between the members under one key, one for each line, block and other component."""
    its = members.join(text.select(F.col("id").alias("tid"), "line"), F.col("id") == F.col("tid"))
    size = members.where("own").groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("key", "of")
    sized = its.join(size, F.col("key") == F.col("of"))
    block = sized.where("own").groupBy(F.col("key").alias("bkey"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("bno")).agg(F.collect_list(F.struct("id", "component", "letters", "line")).alias("block"))
    asked = sized.withColumn("no", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = asked.join(block, (F.col("key") == F.col("bkey")) & (F.col("no") == F.col("bno")))
    # two lines that are both indexed meet from one side; Spark's own bounded distance rules out what the band need not be moved over
    near = F.filter("block", lambda y: (y.component != F.col("component")) & (~F.col("own") | (y.id < F.col("id"))) & _may_link(y.letters, F.col("letters")) & (F.levenshtein(y.line, F.col("line"), EDITS) >= 0) & within_edits(y.line, F.col("line")))
    first = F.map_values(F.aggregate(near, F.expr("map()").cast("map<bigint,bigint>"), lambda acc, y: F.when(F.map_contains_key(acc, y.component), acc).otherwise(F.map_concat(acc, F.create_map(y.component, y.id)))))
    return met.select("id", F.explode(first).alias("id2")).select(*_pair("id", "id2")).distinct()


def line_components(ws: Workspace, docs_lines) -> DataFrame:
    """(id, component) of the lines that have a different line within EDITS; every such pair is in one component."""
    # keys are made before equal lines are put together: they move with less than the line, and equal lines give equal rows
    lines = docs_lines().select("line", F.length("line").alias("n")).where(F.col("n") >= MIN_CHARS)
    # staged before they are exploded, or all keys would go along with each posting
    keyed = ws.keep(lines.select(F.xxhash64("line").alias("id"), postings(F.col("line"), F.col("n")).alias("keys")).distinct())
    hot = _crowded(ws, keyed.select(F.explode(F.slice("keys", 1, EDITS + 1)).alias("key")))
    every = keyed.select("id", F.posexplode("keys").alias("pos", "key"))
    crowd = broadcast_if_small(hot, 8)
    few = every.join(crowd, F.col("key") == F.col("of"), "left_anti")
    own = few.where(F.col("pos") <= EDITS).select(F.col("id").alias("id2"), F.col("key").alias("key2"))
    # lines of one length would meet from both sides; one is enough
    once = F.when(F.col("pos") < sum(less == 0 for less, _, _ in LAYOUT), F.col("id") < F.col("id2")).otherwise(F.col("id") != F.col("id2"))
    pairs = ws.keep(few.join(own, (F.col("key") == F.col("key2")) & once).select(*_pair("id", "id2")).distinct())
    member = one_partition(ws.keep(every.join(crowd, F.col("key") == F.col("of"), "left_semi")))
    ws.drop(keyed)
    ids = ws.keep(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(member.select("id")).distinct())
    text = docs_lines().where(F.length("line") >= MIN_CHARS).withColumn("id", F.xxhash64("line")).join(broadcast_if_small(ids, 8), "id", "left_semi").select("id", "line").distinct()
    text = one_partition(ws.keep(text.withColumn("letters", letter_counts(F.col("line")))), "line")
    edges = one_partition(_verified(ws, _with_letters(one_partition(pairs), text), text))
    if member.count() == 0:
        return components(ws, edges, HERE)
    at = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in LAYOUT]), F.col("pos") + 1)
    cut = member.select("key", "id", at(0).alias("less"), (F.col("pos") <= EDITS).alias("own"), at(1).alias("number"), at(2).alias("shift")).join(text.select(F.col("id").alias("tid"), "line", "letters"), F.col("id") == F.col("tid"))
    rest = _without(F.col("line"), F.length("line"), F.col("less"), F.col("number"), F.col("shift"))
    return _large_groups(ws, _small_or_not(ws, cut.select("key", "id", "less", "own", rest.alias("rest"), "letters")), text, edges)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near_removed, n_linked, n_kept_chars for each document.

    n_removed: lines that are not the first of their component; n_near_removed: those of
    them that differ from its first line; n_linked: the document's lines whose component
    has different lines.
    """
    ws = Workspace(docs.sparkSession, "lines")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def docs_lines() -> DataFrame:
        return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))

    blank = ~F.col("line").rlike(r"[^\x20\x09-\x0D]")
    found = line_components(ws, docs_lines)
    lines = ws.keep(docs_lines().select("doc_id", "pos", F.xxhash64("line").alias("id"), F.length("line").alias("n"), blank.alias("blank")))
    comp = broadcast_if_small(ws.keep(found.withColumnRenamed("id", "cid")), 16)
    named = ws.keep(lines.join(comp, F.col("id") == F.col("cid"), "left").select("doc_id", "pos", "id", "n", "blank", F.coalesce("component", "id").alias("class"), F.col("cid").isNotNull().alias("linked")))
    many = ws.keep(named.where("NOT blank").groupBy("class").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1").select(F.col("class").alias("of"), "first_doc"))
    again = named.where("NOT blank").join(many, F.col("class") == F.col("of"))
    lead = ws.keep(again.where("doc_id = first_doc").groupBy("of").agg(F.min(F.struct("pos", "id")).alias("lead")).join(many.withColumnRenamed("of", "of2"), F.col("of") == F.col("of2")).select("of", "first_doc", F.col("lead.pos").alias("first_pos"), F.col("lead.id").alias("first_id")))
    marked = named.join(lead, (F.col("class") == F.col("of")) & ~F.col("blank"), "left")
    gone = F.col("of").isNotNull() & ~((F.col("doc_id") == F.col("first_doc")) & (F.col("pos") == F.col("first_pos")))
    out = marked.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        F.sum(gone.cast("long")).alias("n_removed"),
        F.sum((gone & (F.col("id") != F.col("first_id"))).cast("long")).alias("n_near_removed"),
        F.sum(F.col("linked").cast("long")).alias("n_linked"),
        F.sum(F.when(gone, 0).otherwise(F.col("n"))).cast("long").alias("n_kept_chars"),
    )
    return ws.finish(out)
