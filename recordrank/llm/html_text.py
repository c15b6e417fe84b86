"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of each host.

A page's token stream, tags and texts, is read as nested sequences. A wrapper is such a sequence with text slots, whose parts may be optional or
repeated. Two are aligned item by item: what one has and the other lacks becomes optional, what stands several times in a row becomes a repeated
group, and texts become slots. Pages are reduced to their structure first, so a host's wrapper is inferred from its distinct structures, in rounds of bounded
groups; every page of the host has a part in it. Each structure is then aligned to the wrapper, which gives each text its slot.

Slots are kept or left out for the whole host: by the tags and names around them, by the share of linked text, and by texts that stay the same while pages differ.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .scratch import drop, keep

#: Structures or partial wrappers that one task merges at a time.
GROUP = 256
#: Levels of elements that a structure has; an element further down only ends a block of text.
DEEPEST = 100

# Fixed values of the markup language, and names that sites commonly give to parts of pages.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, up to their end tag.
SKIPPED = set("script style title textarea template noscript iframe noframes xmp svg math object audio video canvas".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: A start tag of these ends an open one of the second set, up to the nearest of the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
APART = set("nav header footer aside form menu button select dialog".split())
APART_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus discussion widget widgets pagination pager search skip copyright disclaimer complementary contentinfo responses reactions feedback warning".split()
)
MAIN_NAMES = set("article content entry post story main body text".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>=]+|=)*+)>|<(?=[A-Za-z/]).*\Z|[^<]+|<", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Item:
    """A part of a sequence: a text slot ``#``, an element with its own sequence, or a repeated group of several parts."""

    __slots__ = ("blocks", "kids", "label", "many", "optional")

    def __init__(self, label: str, kids: list[Item] | None = None, optional: bool = False, many: bool = False, blocks: list[int] | None = None):
        self.label, self.kids, self.optional, self.many, self.blocks = label, kids or [], optional, many, blocks or []

    @property
    def width(self) -> int:
        """How many items of a plain sequence one occurrence takes."""
        return len(self.kids) if self.label.startswith("(") else 1


def names_of(label: str) -> set[str]:
    """Words in the class, id and role of an element's label; those that say what a part has or lacks, or that it holds the main part besides others, are left out."""
    out: set[str] = set()
    for token in label.split(".")[1:]:
        words = {w.lower() for w in _PART.findall(token)}
        if not words & {"has", "with", "no"} and not (words & {"wrap", "wrapper", "container", "layout"} and words & MAIN_NAMES and words & APART_NAMES):
            out |= words
    return out


def parse(page: str) -> tuple[list[Item], list[tuple[str, int]]]:
    """A page's sequence, repetitions folded, and its blocks of text with their linked characters.

    Tags that only mark words are no part of it, unless their names set them apart; elements without text are left out. What is not closed ends with its parent. A tag that the page's end cuts is none.
    """
    root = Item("")
    stack = [root]
    blocks: list[tuple[str, int]] = []
    words: list[str] = []
    linked: list[str] = []
    in_link = False

    def flush() -> None:
        nonlocal in_link
        text = " ".join("".join(words).split())
        if text:
            stack[-1].kids.append(Item("#", blocks=[len(blocks)]))
            blocks.append((text, min(len(text), len(" ".join("".join(linked).split())))))
        words.clear()
        linked.clear()

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            item = stack.pop()
            if item.kids:
                item.kids = fold(item.kids)
            else:
                stack[-1].kids.remove(item)

    skip, depth = "", 0
    deeper: dict[str, int] = {}
    for token in _TOKEN.finditer(page):
        tag = token[2]
        if tag is None:
            raw = token[0]
            if not skip and (raw[0] != "<" or raw == "<"):
                text = html.unescape(raw) if "&" in raw else raw
                words.append(text)
                if in_link:
                    linked.append(text)
            continue
        tag, ends = tag.lower(), bool(token[1])
        if skip:
            if tag == skip:
                depth += -1 if ends else 1
                if not depth:
                    skip = ""
            continue
        if tag in SKIPPED:
            if not ends and not token[3].endswith("/"):
                skip, depth = tag, 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                words.append("\n")
            continue
        if ends:
            if tag in INLINE:
                in_link = in_link and tag != "a"
                if not any(x.label.split(".", 1)[0] == tag for x in stack):
                    continue
            if deeper.get(tag):
                deeper[tag] -= 1
                flush()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].label.split(".", 1)[0] == tag:
                    close(k)
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        given = sorted({t for m in _NAMES.finditer(token[3]) for t in (m[1] or m[2] or m[3] or "").split() if t.replace("-", "").replace("_", "").isalpha()}) if "=" in token[3] else []
        label = ".".join([tag, *given])
        if tag in INLINE:
            in_link = in_link or tag == "a"
            if not names_of(label) & APART_NAMES:
                continue
        else:
            in_link = False
            if stack[-1].label.split(".", 1)[0] == "p":
                close(len(stack) - 1)
            if tag in CLOSES:
                ended, within = CLOSES[tag]
                k = len(stack) - 1
                while k and (name := stack[k].label.split(".", 1)[0]) not in within:
                    if name in ended:
                        close(k)
                    k -= 1
        flush()
        if len(stack) > DEEPEST:
            deeper[tag] = deeper.get(tag, 0) + 1
            continue
        item = Item(label)
        stack[-1].kids.append(item)
        stack.append(item)
    close(1)
    return fold(root.kids), blocks


_RAW_END = {t: re.compile(f"</{t}\\s*>", re.I) for t in ("script", "style", "title", "textarea", "iframe", "noframes", "xmp")}
_RAW = re.compile(r"<(script|style|title|textarea|iframe|noframes|xmp)\b[^>]*>", re.I)


def without_raw(page: str) -> str:
    """A page without the elements whose content is not markup: their text may look like tags. Comments are passed over as they are."""
    out, at = [], 0
    comment = page.find("<!--")
    while m := _RAW.search(page, at):
        if 0 <= comment < m.start():
            end = page.find("-->", comment + 4)
            end = len(page) if end < 0 else end + 3
            out.append(page[at:comment])
            at = end
            comment = page.find("<!--", at)
            continue
        out.append(page[at : m.start()])
        end = _RAW_END[m[1].lower()].search(page, m.end())
        at = end.end() if end else len(page)
        if 0 <= comment < at:
            comment = page.find("<!--", at)
    out.append(page[at:])
    return "".join(out)


def _alike(a: Item, b: Item) -> bool:
    """Of one label, and not of contents that have nothing in common."""
    if a.label != b.label:
        return False
    mine, other = {k.label for k in a.kids}, {k.label for k in b.kids}
    return not mine or not other or 2 * len(mine & other) >= min(len(mine), len(other))


def fold(items: list[Item]) -> list[Item]:
    """A sequence in which what stands several times in a row, alone or in groups of two or three, is one repeated item."""
    for period in (1, 2, 3):
        out: list[Item] = []
        i = 0
        while i < len(items):
            unit = items[i : i + period]
            j = i + period
            group = None
            while j + period <= len(items) and (period == 1 or len({x.label for x in unit}) > 1) and all(_alike(a, b) for a, b in zip(unit, items[j : j + period])):
                unit = [_join(a, b) for a, b in zip(unit, items[j : j + period])]
                j += period
                group = unit
            if group is None:
                out.append(items[i])
                i += 1
            else:
                if period == 1:
                    group[0].many = True
                    out.append(group[0])
                else:
                    out.append(Item("(" + " ".join(x.label for x in group) + ")", group, many=True))
                i = j
        items = out
    return items


def _join(a: Item, b: Item) -> Item:
    """Two items of one label as one."""
    kids = a.kids if not b.kids else b.kids if not a.kids else [_join(x, y) for x, y in zip(a.kids, b.kids)] if a.width > 1 else merge(a.kids, b.kids)
    return Item(a.label, kids, a.optional or b.optional, a.many or b.many, a.blocks + b.blocks)


def pairs(a: list[Item], b: list[Item]) -> list[tuple[int, int, int, int]]:
    """The alignment of two sequences that has most in common: runs ``a[i:i2]`` that stand for ``b[j:j2]``, in order.

    A repeated group stands for as many plain items as it has, and a repeated item of ``a`` for several runs of ``b``.
    """

    def runs(i: int, j: int) -> Iterator[tuple[int, int, int]]:
        x, y = a[i], b[j]
        if x.label == y.label:
            if _alike(x, y):
                yield 1, 1, 1 + len({k.label for k in x.kids} & {k.label for k in y.kids})
        elif x.width > 1 and [k.label for k in b[j : j + x.width]] == [k.label for k in x.kids]:
            yield 1, x.width, x.width
        elif y.width > 1 and [k.label for k in a[i : i + y.width]] == [k.label for k in y.kids]:
            yield y.width, 1, y.width

    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    step: dict[tuple[int, int], tuple[int, int, bool] | None] = {}
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            top, how = (best[i + 1][j], (1, 0, False)) if best[i + 1][j] >= best[i][j + 1] else (best[i][j + 1], (0, 1, False))
            for di, dj, gain in runs(i, j):
                if gain + best[i + di][j + dj] >= top:
                    top, how = gain + best[i + di][j + dj], (di, dj, True)
                if di == 1 and a[i].many and gain + best[i][j + dj] > top:
                    top, how = gain + best[i][j + dj], (0, dj, True)
            best[i][j], step[i, j] = top, how
    out, i, j = [], 0, 0
    while i < n and j < m:
        di, dj, hit = step[i, j]
        if hit:
            out.append((i, i + max(di, 1), j, j + dj))
        i, j = i + di, j + dj
    return out


def _unit(run: list[Item]) -> Item:
    return run[0] if len(run) == 1 else Item("(" + " ".join(x.label for x in run) + ")", run, many=True)


def merge(a: list[Item], b: list[Item]) -> list[Item]:
    """The least general sequence found for both: aligned items as one, all others optional, repetitions folded."""
    out: list[Item] = []
    i = j = 0
    for i1, i2, j1, j2 in pairs(a, b):
        for x in a[i:i1] + b[j:j1]:
            x.optional = True
            out.append(x)
        if i1 < i:
            # the repeated item matched again: what it has become takes this run in as well
            at = next(k for k in range(len(out) - 1, -1, -1) if out[k].label == _unit(a[i1:i2]).label)
            out[at] = _join(out[at], _unit(b[j1:j2]))
        else:
            out.append(_join(_unit(a[i1:i2]), _unit(b[j1:j2])))
        i, j = i2, j2
    for x in a[i:] + b[j:]:
        x.optional = True
        out.append(x)
    return fold(out)


def leaves(items: list[Item], above: tuple[str, ...] = ()) -> Iterator[tuple[Item, tuple[str, ...]]]:
    """Text slots in order, with the labels around them."""
    for x in items:
        if x.label == "#":
            yield x, above
        else:
            yield from leaves(x.kids, above if x.width > 1 else (*above, x.label))


def write(items: list[Item]) -> str:
    """A wrapper or structure as text."""
    plain = lambda x: [x.label, (1 if x.optional else 0) + (2 if x.many else 0), *([[plain(k) for k in x.kids]] if x.kids else [])]
    return json.dumps([plain(x) for x in items], ensure_ascii=False, separators=(",", ":"))


def read(text: str) -> list[Item]:
    """What ``write`` has written, its text slots numbered in ``blocks``."""
    build = lambda v: Item(v[0], [build(k) for k in v[2]] if len(v) > 2 else [], bool(v[1] & 1), bool(v[1] & 2))
    items = [build(v) for v in json.loads(text)]
    for k, (slot, _) in enumerate(leaves(items)):
        slot.blocks = [k]
    return items


def locate(structure: list[Item], wrapper: list[Item], out: dict[int, int]) -> None:
    """Into ``out``: the wrapper's slot of each text slot of a structure, as far as they align."""
    for i1, i2, j1, j2 in pairs(wrapper, structure):
        one, other = wrapper[i1:i2], structure[j1:j2]
        if len(one) != len(other):
            one, other = (one[0].kids, other) if len(other) > 1 else (one, other[0].kids)
            for x, y in zip(one, other):
                locate([y], [x], out)
            continue
        for x, y in zip(one, other):
            if x.label == "#":
                out.update((k, x.blocks[0]) for k in y.blocks)
            elif x.width > 1:
                for p, q in zip(x.kids, y.kids):
                    locate([q], [p], out)
            else:
                locate(y.kids, x.kids, out)


def place(labels: tuple[str, ...]) -> int:
    """How far the labels around a slot speak for it: -1 apart from the article, else 3 within an article, 2 the main part, 1 a part named as content, 0 unknown."""
    tags = [x.split(".", 1)[0] for x in labels]
    names = [set() if t in ("html", "body") else names_of(x) for t, x in zip(tags, labels)]
    main = [t in ("article", "main") or bool(n & MAIN_NAMES) for t, n in zip(tags, names)]
    # an article or main part is not set apart by names, but for articles that are comments or adverts
    apart = [k for k, (t, n) in enumerate(zip(tags, names)) if t in APART or n & APART_NAMES and t != "main" and (t != "article" or not n & MAIN_NAMES)]
    if apart:
        # the article's own header may hold its heading
        headers = all(tags[k] == "header" or names[k] & APART_NAMES == {"header"} for k in apart)
        if not (headers and any(main[: apart[0]]) and tags[-1] in HEADINGS):
            return -1
    if "article" in tags:
        return 3
    return 2 if "main" in tags or any("main" in n for n in names) else int(any(main))


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, structure`` and the blocks of text with their place in the structure. Null html has none."""
    kinds = pages.schema
    block = StructType([StructField("at", IntegerType()), StructField("linked", IntegerType()), StructField("text", StringType())])
    schema = StructType([StructField("page_id", kinds["page_id"].dataType), StructField("url", StringType()), StructField("host", StringType()), StructField("structure", StringType()), StructField("blocks", ArrayType(block))])
    host = F.lower(F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.list_(pa.struct([("at", pa.int32()), ("linked", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            shapes, found = [], []
            for page in batch.column(3).to_pylist():
                items, blocks = parse(without_raw(page)) if page else ([], [])
                at = {k: i for i, (slot, _) in enumerate(leaves(items)) for k in slot.blocks}
                shapes.append(write(items))
                found.append([{"at": at[k], "linked": n, "text": t} for k, (t, n) in enumerate(blocks)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shapes, pa.string()), pa.array(found, cell)], names=["page_id", "url", "host", "structure", "blocks"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, schema)


def wrappers(shapes: DataFrame) -> DataFrame:
    """One wrapper for each host, from its distinct structures: ``host, wrapper``.

    Structures are merged in groups of about ``GROUP``, then the groups' wrappers, until each host has one.
    """

    def run(part: pa.Table) -> pa.Table:
        rows = sorted(set(part["structure"].to_pylist()))
        whole = read(rows[0])
        for r in rows[1:]:
            whole = merge(whole, read(r))
        return pa.table({"host": [part["host"][0].as_py()], "structure": [write(whole)]})

    rest = shapes.select("host", "structure")
    while True:
        sizes = rest.groupBy("host").agg(F.count("*").alias("_n"))
        most = sizes.agg(F.max("_n")).first()[0] or 0
        groups = F.ceil(F.col("_n") / GROUP)
        salted = rest.join(sizes, "host").withColumn("_g", F.pmod(F.xxhash64("structure"), groups)).drop("_n")
        merged = keep(salted.groupBy("host", "_g").applyInArrow(run, "host string, structure string"), "wrappers")
        if rest is not shapes:
            drop(rest)
        rest = merged
        if most <= GROUP:
            return rest.withColumnRenamed("structure", "wrapper")


def _located(rows: DataFrame) -> DataFrame:
    """For each structure the wrapper's slot of each of its text slots, and how far their surroundings speak for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = pa.schema([("host", pa.string()), ("structure", pa.string()), ("slots", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))])
        for batch in batches:
            slots, places, known = [], [], {}
            for shape, wrapper in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if wrapper not in known:
                    known = {wrapper: [place(labels) for _, labels in leaves(read(wrapper))]}
                items, found = read(shape), {}
                locate(items, read(wrapper), found)
                own = [(found.get(k, -1), place(labels)) for k, (_, labels) in enumerate(leaves(items))]
                slots.append([s for s, _ in own])
                # the wrapper's slot decides; where a structure did not align, its own labels do
                places.append([known[wrapper][s] if s >= 0 else p for s, p in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, form.field(2).type), pa.array(places, form.field(3).type)], schema=form)

    return rows.select("host", "structure", "wrapper").mapInArrow(run, "host string, structure string, slots array<int>, places array<int>")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each page: its blocks of main text, one to a line, and their code points.

    Character references are decoded, white space within a block is one space. A page without html, or without main text, has an empty text; pages without a host in
    their address form one group. Repeated ids and pages are kept as they are. Pages cut short are read as far as they go.
    """
    table = keep(parsed(pages), "parsed")
    shapes = keep(table.select("host", "structure").distinct(), "shapes")
    whole = wrappers(shapes)
    # structures and wrappers are joined by size: Spark broadcasts the smaller side only below its threshold, and splits hot hosts otherwise
    where = keep(_located(shapes.join(whole, "host")), "slots")
    slot = table.select("host", "structure", F.explode("blocks").alias("b")).join(where, ["host", "structure"]).select("host", F.get("slots", F.col("b.at")).alias("slot"), F.get("places", F.col("b.at")).alias("place"), "b.text", "b.linked")
    stats = slot.where("slot >= 0 and place >= 0").groupBy("host", "slot").agg(F.count("*").alias("n"), F.approx_count_distinct("text", 0.02).alias("kinds"), F.sum(F.length("text")).alias("chars"), F.sum("linked").alias("linked"))
    differ = stats.groupBy("host").agg(F.max("kinds").alias("_most"))
    # a link list, or a short text that stays while the host's pages differ
    fixed = (F.col("n") >= 10) & (F.col("kinds") * 10 <= F.col("n")) & (F.col("kinds") * 5 <= F.col("_most")) & (F.col("chars") < 200 * F.col("n"))
    out = stats.join(differ, "host").where(fixed | (F.col("linked") * 10 >= F.col("chars") * 9)).groupBy("host").agg(F.collect_set("slot").alias("out"))
    # the best known place of a structure that still has text is its article
    ok = where.join(out, "host", "left").withColumn("_p", F.transform(F.arrays_zip("slots", "places"), lambda x: F.when(F.array_contains(F.coalesce("out", F.array()), x["slots"]), F.lit(-1)).otherwise(x["places"])))
    # written, so that its size is known when the pages are joined with it, and pages are not shuffled where it is small
    ok = keep(ok.select("host", "structure", F.transform("_p", lambda p: (p >= 0) & (p == F.array_max("_p"))).alias("ok")), "kept")
    blocks = F.transform(F.filter("blocks", lambda b: F.get("ok", b["at"])), lambda b: b["text"])
    text = F.array_join(blocks, "\n")
    return table.join(ok, ["host", "structure"], "left").select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast(LongType()))
