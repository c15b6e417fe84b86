"""Near-duplicate lines by a segment-partition edit join, with DataFrame functions only.

A line is cut into one segment more than the edits its length allows, so two lines within those share a segment whole. Segments
of the first half are placed from the line's start and those of the second half from its end, and all are of one size that follows from the
length. With ``i`` segments before it a segment lies at most ``i`` places off, whatever the other line's length, so a line probes 1, 3, 5, ...
substrings for the segments from either end inwards, and those again only where lines shorter by the edits allowed have segments of another size.
Pairs that share a key, whose lengths and letter counts differ by no more than the edits allow, lose what they begin and end with alike. Of what is left
enough pieces must lie near their places; then the edit distance decides: the built-in one, or for long rests a banded one whose band is a bit vector in one integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import drop, keep

#: Letters whose counts are compared before verification, at most 8.
_COUNTED = "etanoirs"
#: Characters of what is left of a pair up to which the built-in distance, whose time grows with their square, is the faster one.
_SHORT = 2000
#: Characters of a line for each edit beyond the first.
PER_EDIT = 12


def _allowed(length: Column, threshold: int) -> Column:
    """Edits within which a line is near the shorter one of a pair: one for each ``PER_EDIT`` characters, at least one, at most ``threshold``."""
    return F.least(F.lit(threshold), F.greatest(F.lit(1), F.floor(length / PER_EDIT))).cast("int")


def _with_layouts(texts: DataFrame, threshold: int) -> DataFrame:
    """``texts(line, n)`` with ``layouts``, each line's own first, then those of lines shorter by the edits allowed, and ``k0``, ``k1``, ..., the keys of its own segments.

    A layout is edits and segment size in one integer, ``size * 64 + edits``. The size is rounded down, by a quarter at most, so that lines of
    nearly the same length mostly have one layout. Each step is a projection of its own, as the next one uses its columns more than once.
    """
    less = range(threshold + 1)
    texts = texts.select("*", *[_allowed(F.col("n") - i, threshold).alias(f"_e{i}") for i in less])
    texts = texts.select("*", *[F.floor((F.col("n") - i) / (F.col(f"_e{i}") + 1)).cast("int").alias(f"_s{i}") for i in less])
    rounded = lambda s: s.bitwiseAND(F.when(s < 8, -1).when(s < 16, -2).when(s < 32, -4).otherwise(-8))
    every = F.array(*[F.when(F.col(f"_e{i}") >= i, rounded(F.col(f"_s{i}")) * 64 + F.col(f"_e{i}")) for i in less])
    texts = texts.withColumn("layouts", F.array_compact(F.array_distinct(every))).drop(*[f"_{c}{i}" for c in "es" for i in less])
    slots, named = _slots(threshold), texts.columns
    placed = _placed(texts.select("*", F.get("layouts", F.lit(0)).alias("layout")), slots, False, named)
    return placed.select(*named, *[key.alias(f"k{k}") for (k, *_), key in zip(slots, _keys(slots, False), strict=True)])


def _with_rests(texts: DataFrame) -> DataFrame:
    """``texts`` with ``rest1``, ``rest2``, ...: the line without the first of the letters ``_COUNTED``, without the first two, ... Each is read once and is shorter than the one before."""
    texts = texts.withColumn("rest0", F.col("line"))
    for i, c in enumerate(_COUNTED):
        texts = texts.select("*", F.replace(f"rest{i}", F.lit(c)).alias(f"rest{i + 1}"))
    return texts.drop("rest0")


def _traits(line: Column, rests: list[Column] | None = None) -> Column:
    """The counts of the letters ``_COUNTED``, modulo 16, a byte for each; ``rests`` are the columns of ``_with_rests``, if there are such."""
    pairs = zip([line, *rests], rests, strict=False) if rests else [(line, F.replace(line, F.lit(c))) for c in _COUNTED]
    counts = [F.shiftleft((F.octet_length(whole) - F.octet_length(rest)).bitwiseAND(F.lit(15)).cast("long"), 8 * i) for i, (whole, rest) in enumerate(pairs)]
    return sum(counts[1:], counts[0])


def _slots(threshold: int) -> list[tuple[int, bool, int, int]]:
    """Segments as ``(number, from the end, place counted from that end, edits from which a line has it)``."""
    return [(e, e % 2 == 1, e // 2, e) for e in range(threshold + 1)]


def _placed(lines: DataFrame, slots: list[tuple[int, bool, int, int]], moved: bool, also: list[str]) -> DataFrame:
    """What ``_keys`` needs of ``lines(line, n, layout)``, and the columns ``also``."""
    lines = lines.select("*", F.floor(F.col("layout") / 64).cast("int").alias("size"), F.col("layout").bitwiseAND(F.lit(63)).alias("edits"))
    lines = lines.select("*", *[(F.col("n") - F.col("size") * (place + 1) if back else F.col("size") * place).cast("int").alias(f"start{k}") for k, back, place, _ in slots])
    # the characters around a place are cut out once for all moves
    around = [(k, F.greatest(F.col(f"start{k}") - (place if moved else 0), F.lit(0)), place if moved else 0) for k, _, place, _ in slots]
    also = [*also, *[c for c in ("n", "size", "edits") if c not in also]]
    return lines.select(*also, *[f"start{k}" for k, *_ in slots], *[at.alias(f"from{k}") for k, at, _ in around], *[F.substring("line", at + 1, F.col("size") + 2 * reach).alias(f"cut{k}") for k, at, reach in around])


def _keys(slots: list[tuple[int, bool, int, int]], moved: bool) -> list[Column]:
    """Keys of the segments of ``_placed`` lines, at their places or ``moved`` from there, null where a line has none."""
    keys = []
    for k, _, place, least in slots:
        for move in range(-place, place + 1) if moved else (0,):
            start = F.col(f"start{k}") + move
            key = F.xxhash64(F.lit(k), F.substring(f"cut{k}", start - F.col(f"from{k}") + 1, F.col("size")))
            keys.append(F.when((F.col("edits") >= least) & (start >= 0) & (start + F.col("size") <= F.col("n")), key))
    return keys


def _candidates(texts: DataFrame, slots: list[tuple[int, bool, int, int]], threshold: int) -> DataFrame:
    """Pairs ``(h, g)`` of lines of ``texts(id, traits)``, with the columns of ``_with_layouts``, that share a segment of ``slots``, lengths and letter counts allowing.

    An edit adds one to the letters that one line has more than the other, or to those that the other has more, or to both; letters that are not
    counted one by one are one class, whose number follows from the length. Counts are compared modulo 16 and lengths, the lowest byte of an id, modulo
    256, so that no pair within the edits is lost.
    """
    exploded = lambda keys: F.explode(F.array(*keys)).alias("key")
    index = texts.select(F.col("id").alias("h"), F.col("traits").alias("x"), exploded([f"k{k}" for k, *_ in slots])).where("key is not null")
    probe = _placed(texts.select("id", "line", "n", "traits", F.explode("layouts").alias("layout")), slots, True, ["id", "traits"])
    probe = probe.select(F.col("id").alias("g"), F.col("traits").alias("y"), exploded(_keys(slots, True))).where("key is not null")
    byte = lambda v: F.lit(int.from_bytes(bytes([v] * 8), "big"))
    apart = (F.col("x").bitwiseOR(byte(16)) - F.col("y")).bitwiseAND(byte(15))
    fewer = F.shiftright(apart, 3).bitwiseAND(byte(1))  # letters that h has fewer of
    of = F.shiftleft(fewer, 4) - fewer
    # the sum of a number's bytes is its remainder by 255; the condition stays small, as the join's code is compiled only up to a size
    more = (apart - apart.bitwiseAND(of)) % 255
    less = (F.shiftleft(fewer, 4) - apart.bitwiseAND(of)) % 255
    longer = (F.col("g") - F.col("h")).bitwiseAND(F.lit(255))
    near = (longer + more <= threshold) & (less <= threshold) & ((longer > 0) | (F.col("h") < F.col("g")))
    return index.hint("shuffle_hash").join(probe, (index["key"] == probe["key"]) & near).select("h", "g").distinct()


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """The edit distance of two strings if it is at most ``threshold``, else a larger number.

    The rows within ``threshold`` of the diagonal are the bits of one integer, so a step along ``b`` is a few integer operations.
    ``a`` is not shorter than ``b``.
    """
    width = 2 * threshold + 2
    full, top = (1 << width) - 1, width - 1
    kind = "struct<vp:int,vn:int,d:int>"

    def bit(v: Column, place: Column | int) -> Column:
        return F.shiftright(v, place).bitwiseAND(F.lit(1)) if isinstance(place, int) else F.call_function("shiftright", v, place).bitwiseAND(F.lit(1))

    def step(s: Column, c: Column, x: Column, n: Column) -> Column:
        ch, j = c["ch"], c["j"]
        pm = F.lit(0)
        for t in range(1, width):
            pm = pm + F.when(F.get(x, j - threshold - 1 + t) == ch, F.lit(1 << t)).otherwise(0)
        vp, vn = s["vp"], s["vn"]
        d0 = (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(F.lit(full))
        inner = F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"))

        def after(v: Column) -> Column:
            d0, vp, vn = v["d0"], v["vp"], v["vn"]
            hp = vn.bitwiseOR(d0.bitwiseOR(vp).bitwiseXOR(F.lit(full)))
            hn = d0.bitwiseAND(vp)
            down = j < n - threshold  # the last row is not in the band yet: follow the diagonal
            place = F.lit(top - 1) - (j - (n - threshold))
            d = s["d"] + F.when(down, F.lit(1) - bit(d0, top)).otherwise(bit(hp, place) - bit(hn, place))
            lower = F.shiftright(d0, 1)
            return F.struct(hn.bitwiseOR(lower.bitwiseOR(hp).bitwiseXOR(F.lit(full))).alias("vp"), lower.bitwiseAND(hp).alias("vn"), d.cast("int").alias("d")).cast(kind)

        return F.transform(F.array(inner), after)[0]

    def walk(v: Column) -> Column:
        start = F.struct(F.lit(full ^ ((1 << (threshold + 1)) - 1)).alias("vp"), F.lit(0).alias("vn"), F.least(v["n"], F.lit(threshold)).alias("d")).cast(kind)
        steps = F.transform(v["y"], lambda ch, j: F.struct(ch.alias("ch"), j.alias("j")))
        return F.aggregate(steps, start, lambda s, c: step(s, c, v["x"], v["n"]), lambda s: s["d"])

    # the strings' characters are bound once for all steps
    bound = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"), F.length(a).alias("n")))
    return F.when(F.length(a) - F.length(b) > threshold, threshold + 1).otherwise(F.transform(bound, walk)[0])


def _stripped(pairs: DataFrame, rounds: int = 5) -> DataFrame:
    """Pairs without most of what they begin and end with alike, which leaves their distance: halves, then halves of the rest."""
    a, b = F.col("longer"), F.col("shorter")
    for _ in range(rounds):
        half = F.floor(F.length(b) / 2).cast("int")
        head = F.when(F.left(a, half) == F.left(b, half), half).otherwise(0)
        pairs = pairs.select("h", "g", "allowed", "longer", "shorter", head.alias("cut")).select("h", "g", "allowed", *[F.expr(f"substring({c}, cut + 1)").alias(c) for c in ("longer", "shorter")])
        tail = F.when(F.right(a, half) == F.right(b, half), half).otherwise(0)
        pairs = pairs.select("h", "g", "allowed", "longer", "shorter", tail.alias("cut")).select("h", "g", "allowed", *[F.expr(f"left({c}, length({c}) - cut)").alias(c) for c in ("longer", "shorter")])
    # behind a generator: a filter on the strings is not copied down through the rounds
    return pairs.select("h", "g", "allowed", F.inline(F.array(F.struct("longer", "shorter"))))


def _pieces_alike(longer: Column, shorter: Column, threshold: int) -> Column:
    """Whether enough pieces of the shorter string lie in the longer one near their places: of four times as many pieces as edits, an edit changes one.

    With ``e`` edits left of a piece that is not changed it lies at most ``e`` places off, and counted from the end at most as many as there are edits on its right.
    """
    n, pieces = F.length(shorter), 4 * threshold
    size, over = F.floor(n / pieces).cast("int"), F.length(longer) - n
    reach = F.floor((F.lit(threshold) - over) / 2).cast("int")
    found = []
    for i in range(pieces):
        at = F.greatest(size * i - reach, F.lit(0))
        found.append(F.contains(F.substring(longer, at + 1, size * (i + 1) + over + reach - at), F.substring(shorter, size * i + 1, size)).cast("int"))
    return (over <= threshold) & (sum(found[1:], found[0]) >= pieces - threshold)


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 1, least: int = 8) -> DataFrame:
    """``(doc_id, line_no, n_chars, class_doc, class_line, links, kept)`` for each line that is not blank.

    Lines are cut at line feeds and compared as they are. Lines that are equal, or of at least ``least`` characters and within an edit
    for each ``PER_EDIT`` characters of the shorter one, at least one and at most ``threshold``, are linked; a class is what links reach, named by its first line in order of document and line number, which is the one kept.
    ``links`` counts the different texts that a line's text is linked with. A null or empty text has no lines. A null id is before
    all others. Rows that repeat an id and a text have lines of the same name, kept together. An empty table gives no rows. Other columns
    are ignored. Lines are told apart by 128 bits of hashes.
    """
    spark = docs.sparkSession
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    hashes = [F.xxhash64("line").alias("ha"), F.xxhash64("line", F.lit(7)).alias("hb")]
    lines = lines.select("*", *hashes)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = keep(lines.select("doc_id", "line_no", F.length("line").alias("n_chars"), "ha", "hb", F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(salts)).cast("int").alias("salt")), "line_places")
    # ids are as written: a table's rows keep them whatever is computed again
    texts = lines.where(F.length("line") >= F.lit(max(least, threshold + 1))).select("ha", "hb", "line").distinct()
    texts = _with_rests(texts.select((F.monotonically_increasing_id() * 256 + F.length("line").bitwiseAND(F.lit(255))).alias("id"), "line", F.length("line").alias("n")))
    texts = texts.select("id", "line", "n", _traits(F.col("line"), [F.col(f"rest{i + 1}") for i in range(len(_COUNTED))]).alias("traits"))
    texts = keep(_with_layouts(texts, threshold), "line_texts", release=True)
    # a few segments at a time: only their keys lie in shuffle files at once
    slots, parts = _slots(threshold), []
    for group in range((len(slots) + 1) // 2):
        chosen = [s for s in (slots[group], slots[-1 - group] if group != len(slots) - 1 - group else None) if s]
        parts.append(keep(_candidates(texts, chosen, threshold), "line_pairs", release=True))
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    pairs = keep(pairs.distinct(), "line_pairs", release=True)
    drop(*parts)
    wanted = pairs.select(F.explode(F.array("h", "g")).alias("id")).distinct()
    # shuffled at any size: the ids grow with the table, and a plan that sends them to all tasks on small tables tells nothing of large ones; by hash, as sorting would move all lines
    near = keep(texts.join(wanted.hint("shuffle_hash"), "id").select("id", *hashes, "line"), "line_near", release=True)
    drop(texts)
    both = pairs.join(near.select(F.col("id").alias("h"), "line"), "h").join(near.select(F.col("id").alias("g"), F.col("line").alias("other")), "g")
    longer, shorter = F.when(F.length("line") >= F.length("other"), F.col("line")).otherwise(F.col("other")), F.when(F.length("line") >= F.length("other"), F.col("other")).otherwise(F.col("line"))
    both = _stripped(both.select("h", "g", _allowed(F.least(F.length("line"), F.length("other")), threshold).alias("allowed"), longer.alias("longer"), shorter.alias("shorter")))
    both = both.where(_pieces_alike(F.col("longer"), F.col("shorter"), threshold))
    built_in = F.levenshtein("longer", "shorter", threshold)  # -1 beyond the threshold
    near_enough = F.when(F.length("longer") <= _SHORT, built_in.between(0, F.col("allowed"))).otherwise(banded_distance(F.col("longer"), F.col("shorter"), threshold) <= F.col("allowed"))
    links = keep(both.where(near_enough).select(F.col("h").alias("a"), F.col("g").alias("b")), "line_links", release=True)
    drop(pairs)
    found = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    linked = found.join(degree, "node").join(near.select(F.col("id").alias("node"), "ha", "hb"), "node").select("ha", "hb", "component", "links")
    # by text and salt first, so that a text with any share of the lines is spread over tasks, here and in the last join
    firsts = at.groupBy("ha", "hb", "salt").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    firsts = firsts.groupBy("ha", "hb").agg(F.min("first").alias("first"), F.collect_list("salt").alias("salts"))
    joined = keep(firsts.join(linked, ["ha", "hb"], "left"), "line_firsts", release=True)
    drop(near, links)
    classes = joined.where("component is not null").groupBy("component").agg(F.min("first").alias("class"))
    names = joined.join(classes, "component", "left").select("ha", "hb", F.coalesce("class", "first").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), F.explode("salts").alias("salt"))
    out = at.join(names, ["ha", "hb", "salt"])
    kept = F.struct(F.col("doc_id").alias("doc_id"), F.col("line_no").alias("line_no")).eqNullSafe(F.struct(F.col("class.doc_id").alias("doc_id"), F.col("class.line_no").alias("line_no")))
    return out.select("doc_id", "line_no", "n_chars", F.col("class.doc_id").alias("class_doc"), F.col("class.line_no").alias("class_line"), "links", kept.alias("kept"))
