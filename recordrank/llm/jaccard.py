"""N-gram Jaccard join with adaptive multi-match prefixes.

The global token order is ascending document frequency, then hash. A document of n shingles has the l-prefix of its
first ``n - ceil(t n) + l`` tokens, and two documents that are similar at t share at least l tokens of their l-prefixes. Each
document takes the l whose estimated cost (postings read, plus the candidates they can make times the cost of a
verification) is least; a longer prefix requires as many more shared tokens before a pair is verified.

How it runs:

1. Shingles are hashed to 48 bits and sent, packed, to shards by hash. A shard counts each token's documents and
   answers with the tokens of two documents or more. Tokens of one document come first in the order and never make
   a candidate; a document whose tokens are shared for less than t of its size cannot be similar to any other.
2. What is left are documents with nearly all tokens shared. Those with the same shared tokens and the same number of
   unshared ones behave alike and form one node, so a group of copies is one node however large it is.
3. Nodes that share a token of their prefixes fall into one block (components of stars, one for each posting list).
   Small blocks are bundled; a block of more than ``cell`` nodes is cut into cells, and each pair of cells is a task.
4. In a task, nodes probe an index of prefixes, and pairs with enough matches are verified on the whole token sets, unless
   links found before connect them already. Only a spanning forest of links leaves a task.
5. Components of those links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import drop, keep, shards
from .words import mix, shingles, slices

CHUNK = 1_000_000  # tokens that are sorted and sent together
LEVELS = 4  # the longest extension of a prefix
_PACKED = "shard int, kind int, lo binary, hi binary, doc binary, key binary, size binary, id binary"
_ANSWER = "dest int, kind int, key binary, n binary, count binary, lo binary, hi binary, df binary, shard int, id binary"


def _packed(width: int, n_shards: int):
    """Documents to packed postings, one row for each shard and chunk, and a row that names the chunk's documents."""
    shift = np.uint64(48 - n_shards.bit_length() + 1)

    def send(keys, ids, sizes, tokens, docs) -> Iterator[pa.RecordBatch]:
        keys, ids, sizes = map(np.concatenate, (keys, ids, sizes))
        rows = [(int(keys[0] % np.uint64(n_shards)), 1, b"", b"", b"", keys.tobytes(), sizes.astype(np.uint32).tobytes(), ids.tobytes())]
        token = np.concatenate(tokens)
        order = np.argsort(token)
        token, doc = token[order], np.concatenate(docs)[order]
        cuts = np.searchsorted(token, np.arange(n_shards + 1, dtype=np.uint64) << shift)
        for s in np.flatnonzero(np.diff(cuts)):
            t, d = token[cuts[s] : cuts[s + 1]], doc[cuts[s] : cuts[s + 1]]
            own = np.unique(d)
            rows.append((int(s), 0, t.astype(np.uint32).tobytes(), (t >> np.uint64(32)).astype(np.uint16).tobytes(), np.searchsorted(own, d).astype(np.uint32 if len(own) > 65535 else np.uint16).tobytes(), keys[own].tobytes(), b"", b""))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] * 2 + [pa.binary()] * 6)], names=[x.split()[0] for x in _PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], [], []]
        n = docs = 0
        for batch in batches:
            id_column = batch.column(0).cast(pa.int64())
            ids = np.stack([id_column.fill_null(0).to_numpy(zero_copy_only=False), id_column.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)], 1)
            for part in slices(batch.column(1)):
                token, bounds = shingles(part, width)
                size = np.diff(bounds)
                own = ids[part.at : part.at + part.n_docs]
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(token), dtype=np.uint64)])
                key = mix(mix(own[:, 0].astype(np.uint64) + np.uint64(3)) + own[:, 1].astype(np.uint64) + mix(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(np.uint64)))
                for x, y in zip(held, (key, own, size, token >> np.uint64(16), np.repeat(np.arange(docs, docs + part.n_docs), size))):
                    x.append(y)
                n, docs = n + len(token), docs + part.n_docs
                if n >= CHUNK:
                    yield from send(*held)
                    held, n, docs = [[], [], [], [], []], 0, 0
        if docs:
            yield from send(*held)

    return run


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _answered(n_dest: int):
    """A shard's postings to the shared ones, packed by the document that they belong to."""

    def rows_by_dest(kind, shard, key, columns):
        dest = (key >> np.uint64(20)) % np.uint64(n_dest)
        order = np.lexsort((key, dest))
        cuts = np.searchsorted(dest[order], np.arange(n_dest + 1, dtype=np.uint64))
        for d in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[d] : cuts[d + 1]]
            k = key[at]
            if kind:
                yield {"dest": int(d), "kind": 1, "key": k.tobytes(), "n": columns[0][at].tobytes(), "id": columns[1][at].tobytes()}
            else:
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                token = columns[0][at]
                yield {"dest": int(d), "kind": 0, "shard": shard, "key": k[first].tobytes(), "count": np.diff(np.append(first, len(k))).astype(np.uint32).tobytes(), "lo": token.astype(np.uint32).tobytes(), "hi": (token >> np.uint64(32)).astype(np.uint16).tobytes(), "df": columns[1][at].tobytes()}

    schema = pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.binary()) for x in _ANSWER.split(", ")])

    def run(table: pa.Table) -> pa.Table:
        out = []
        names = table.filter(pa.compute.equal(table["kind"], 1))
        if len(names):
            out += rows_by_dest(1, 0, _joined(names["key"], np.uint64), [_joined(names["size"], np.uint32), _joined(names["id"], np.int64).reshape(-1, 2)])
        table = table.filter(pa.compute.equal(table["kind"], 0))
        if len(table):
            shard = table["shard"][0].as_py()
            docs, base, keys = [], 0, []
            for d, k, lo in zip(table["doc"].to_pylist(), table["key"].to_pylist(), table["lo"].to_pylist()):
                docs.append(np.frombuffer(d, np.uint16 if len(d) * 2 == len(lo) else np.uint32).astype(np.int64) + base)
                keys.append(np.frombuffer(k, np.uint64))
                base += len(keys[-1])
            token = _joined(table["lo"], np.uint32).astype(np.uint64) | (_joined(table["hi"], np.uint16).astype(np.uint64) << np.uint64(32))
            key = np.concatenate(keys)[np.concatenate(docs)]
            order = np.argsort(token)
            token, key = token[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(first, len(token)))
            shared = np.repeat(size >= 2, size)
            # the order needs frequencies as one function of the token only: steps of an eighth of a power of two
            rank = np.minimum(np.log2(size) * 8, 255).astype(np.uint8)
            out += rows_by_dest(0, shard, key[shared], [token[shared], np.repeat(rank, size)[shared]])
        return pa.Table.from_pylist(out, schema)

    return run


_DOCS = "doc_id bigint, copies bigint, n bigint, u bigint, fa bigint, fb bigint, tokens binary"


def _collected(percent: int, n_shards: int):
    """All that shards answered about some documents, to a row for each document; tokens only for those that can be similar to another."""
    schema = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in _DOCS.split(", ")])
    shift = np.uint64(48 - n_shards.bit_length() + 1)

    def run(table: pa.Table) -> pa.Table:
        names = table.filter(pa.compute.equal(table["kind"], 1))
        key, at, copies = np.unique(_joined(names["key"], np.uint64), return_index=True, return_counts=True)
        n, ids = _joined(names["n"], np.uint32)[at].astype(np.int64), _joined(names["id"], np.int64).reshape(-1, 2)[at]
        told = table.filter(pa.compute.equal(table["kind"], 0))
        counts = _joined(told["count"], np.uint32)
        own = np.searchsorted(key, _joined(told["key"], np.uint64))
        doc = np.repeat(own, counts)
        token = _joined(told["lo"], np.uint32).astype(np.uint64) | (_joined(told["hi"], np.uint16).astype(np.uint64) << np.uint64(32))
        rank = _joined(told["df"], np.uint8)
        may = np.bincount(doc, minlength=len(key)) * 100 >= percent * n
        some = may[doc]
        doc, token, rank = doc[some], token[some], rank[some]
        order = np.lexsort((token, rank, doc))
        doc, token, rank = doc[order], token[order], rank[order]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])  # a repeated row says the same again
        doc, token, rank = doc[fresh], token[fresh], rank[fresh]
        shared = np.bincount(doc, minlength=len(key))
        may &= (shared * 100 >= percent * n) & (n > 0)
        bounds = np.concatenate([[0], np.cumsum(shared)])
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(token + np.uint64(c)), dtype=np.uint64)]) for c in (11, 1 << 60)]
        fa, fb = (x[bounds[1:]] - x[bounds[:-1]] for x in sums)
        # a token is stored with its rank above its 48 bits, so that whole values are in the global order
        packed = (rank.astype(np.uint64) << np.uint64(48)) | token
        return pa.Table.from_arrays(
            [pa.array(ids[:, 0], mask=ids[:, 1] == 0), pa.array(copies), pa.array(n), pa.array(n - shared), pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64)), pa.array([packed[bounds[i] : bounds[i + 1]].tobytes() if may[i] else None for i in range(len(key))], pa.binary())], schema=schema
        )

    assert int(shift) > 0
    return run


def _need(n, percent: int):
    return -(-percent * n // 100)


def _posted(percent: int):
    """Nodes to the tokens of their shortest prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("n").to_numpy() - _need(b.column("n").to_numpy(), percent) + 1 - b.column("u").to_numpy()
            tokens = [np.frombuffer(x, np.int64)[:k] for x, k in zip(b.column("tokens").to_pylist(), size)]
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(b.column("node").to_numpy(), [len(x) for x in tokens]))], names=["token", "node"])

    return run


def links(nodes: list[int], n: np.ndarray, u: np.ndarray, tokens: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between nodes, found by adaptive multi-match prefixes.

    ``tokens`` are in the global order. With ``left``, only pairs of which one node is left are of interest.
    """
    k = len(nodes)
    flat, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
    sizes = np.array([len(t) for t in tokens])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    base = n - _need(n, percent) + 1 - u  # of the shared tokens, those in the shortest prefix
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    owner = np.repeat(np.arange(k), sizes)
    level = np.maximum(1, place - np.repeat(base, sizes) + 2)
    posted = np.flatnonzero(level <= LEVELS)
    posted = posted[np.lexsort((level[posted], inverse[posted]))]
    starts = np.searchsorted(inverse[posted], np.arange(len(flat) + 1))
    post_owner, post_level = owner[posted], level[posted]
    length = np.diff(starts)
    label, mark, out = np.arange(k), np.zeros(len(flat), bool), []
    by = np.lexsort((np.array(nodes), u))
    turn = np.empty(k, np.int64)
    turn[by] = np.arange(k)
    for x in by:
        own = inverse[bounds[x] : bounds[x + 1]]
        reads = np.cumsum(length[own[: base[x] + LEVELS - 1]])
        tries = [(reads[min(base[x] + m - 1, len(reads)) - 1] * (1 + sizes[x] / m), m) for m in range(1, LEVELS + 1) if base[x] + m - 1 <= len(own) or m == 1]
        m = min(tries)[1]
        at = np.concatenate([np.arange(starts[t], starts[t + 1]) for t in own[: base[x] + m - 1]])
        at = at[post_level[at] <= m]
        hits = np.bincount(post_owner[at], minlength=k)
        ok = (hits >= m) & (turn < turn[x]) & (label != label[x]) & (np.minimum(n, n[x]) * 100 >= percent * np.maximum(n, n[x]))
        if left is not None:
            ok &= left != left[x]
        found = np.flatnonzero(ok)
        if not len(found):
            continue
        mark[own] = True
        # verify at most some thousand nodes at once, and skip those that have been connected meanwhile
        for i in range(0, len(found), 2048):
            some = found[i : i + 2048]
            some = some[label[some] != label[x]]
            if not len(some):
                continue
            where = np.concatenate([np.arange(bounds[y], bounds[y + 1]) for y in some])
            common = np.add.reduceat(mark[inverse[where]].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
            for y in some[100 * common >= percent * (n[some] + n[x] - common)]:
                if label[y] != label[x]:
                    out.append((nodes[x], nodes[y]))
                    label[label == label[y]] = label[x]
        mark[own] = False
    return out


def _verified(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        order = np.argsort(table["block"].to_numpy(), kind="stable")
        block = table["block"].to_numpy()[order]
        node, n, u, side = (table[c].to_numpy()[order] for c in ("node", "n", "u", "cell"))
        tokens = table["tokens"].combine_chunks()
        for a, b in zip(c := np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), [*c[1:], len(block)]):
            if b - a > 1:
                sides = side[a:b]
                out += links([int(x) for x in node[a:b]], n[a:b], u[a:b], [np.frombuffer(tokens[int(i)].as_buffer(), np.int64) for i in order[a:b]], percent, sides if len(np.unique(sides)) > 1 else None)
        return pa.Table.from_pylist([{"a": x, "b": y} for x, y in out], schema)

    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, cell: int = 2048) -> DataFrame:
    """``(doc_id, n_shingles, component_id, links)`` for each row of ``docs``.

    Rows are linked when ``100 * |A & B| >= percent * |A | B|`` over their sets of word shingles; ``component_id`` is the
    smallest id reachable by links. ``links`` is the number of links of the class's spanning forest at the row's node.
    A row without words has size 0 and is linked with nothing. A null id has a null component, but its row still connects
    others. Rows that repeat an id and a text are copies like others. An empty table gives no rows. Other columns are ignored.
    Tokens are 48-bit hashes.
    """
    spark = docs.sparkSession
    n_shards = shards(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.mapInArrow(_packed(width, n_shards), _PACKED)
    told = sent.groupBy("shard").applyInArrow(_answered(n_shards), _ANSWER)
    all_docs = keep(told.groupBy("dest").applyInArrow(_collected(percent, n_shards), _DOCS), "jaccard_docs", release=True)
    key = ["n", "u", "fa", "fb"]
    similar = all_docs.where("tokens is not null")
    nodes = similar.groupBy(*key).agg(F.min("doc_id").alias("least"), F.sum("copies").alias("copies"), F.min("tokens").alias("tokens"))
    nodes = keep(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard_nodes")  # numbered once, as it is written
    posted = nodes.select("node", "n", "u", "tokens").mapInArrow(_posted(percent), "token bigint, node bigint")
    posted = keep(posted, "jaccard_prefixes")
    heads = posted.groupBy("token").agg(F.min("node").alias("head"), F.count("*").alias("c")).where("c > 1")
    stars = posted.join(heads, "token").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    blocks = keep(components(stars).withColumnRenamed("component", "block"), "jaccard_blocks")
    drop(posted)
    cells = blocks.groupBy("block").agg(F.count("*").alias("k")).select("block", F.ceil(F.col("k") / cell).alias("cells"))
    placed = nodes.select("node", "n", "u", "tokens").join(blocks, "node").join(cells, "block")
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("node", F.lit(5)), "cells"))
    other = F.when(F.col("cells") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    placed = placed.withColumn("other", F.explode(other))
    bundle = F.when(F.col("cells") == 1, F.pmod("block", F.lit(4 * n_shards))).otherwise(F.col("block"))
    placed = placed.select(bundle.alias("bundle"), F.least("cell", "other").alias("ci"), F.greatest("cell", "other").alias("cj"), "block", "node", "n", "u", "cell", "tokens")
    found = keep(placed.groupBy("bundle", "ci", "cj").applyInArrow(_verified(percent), "a bigint, b bigint"), "jaccard_links")
    classes = components(found)
    degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    found = nodes.select(*key, "node", "least", "copies").join(classes, "node", "left").join(degree, "node", "left")
    least = found.where("component is not null").groupBy("component").agg(F.min("least").alias("first"))
    # copies of one node are linked to each other if 100 a >= percent (a + 2 u), for a shared tokens
    alike = (F.col("copies") > 1) & (100 * (F.col("n") - F.col("u")) >= percent * (F.col("n") + F.col("u")))
    found = found.join(least, "component", "left").select(*key, F.when(F.col("component").isNotNull(), F.col("first")).when(alike, F.col("least")).alias("first"), (F.coalesce("links", F.lit(0)) + F.when(alike, F.col("copies") - 1).otherwise(0)).alias("links"))
    rows = similar.drop("tokens").join(found, key, "left").select("doc_id", "copies", "n", "first", "links")
    rows = rows.unionByName(all_docs.where("tokens is null").select("doc_id", "copies", "n", F.lit(None).cast("long").alias("first"), F.lit(0).cast("long").alias("links")))
    rows = rows.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).alias("component_id"), "links")


def first_of_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class, the one with the smallest id, with all its columns.

    Rows that repeat an id and a text stay once. Rows with a null id stay, once for each text. Different texts of one id
    stay or go together.
    """
    named = docs.where(F.col(id_col).isNotNull())
    stay = jaccard_classes(named, id_col, text_col, width, percent).where("component_id = doc_id").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows"))
    rows = unique_and_repeated(docs, stay, F.col(f"row.{id_col}") == F.col("id"), [id_col, text_col]).select("row.*")
    return rows.unionByName(docs.where(F.col(id_col).isNull()).dropDuplicates([text_col]))


def unique_and_repeated(docs: DataFrame, groups: DataFrame, on, same: list[str]) -> DataFrame:
    """``docs``, each as one column ``row``, joined with ``groups``; of a group of more than one row in ``rows``, one row for each value of ``same`` stays.

    As the documents' columns are within ``row``, none can have the name of a column of ``groups``.
    """
    joined = docs.select(F.struct("*").alias("row")).join(groups, on)
    keys = {f"same{i}": F.col(f"row.{c}") for i, c in enumerate(same)}
    return joined.where("rows = 1").unionByName(joined.where("rows > 1").withColumns(keys).dropDuplicates(list(keys)).drop(*keys))
