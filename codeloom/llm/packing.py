"""Filling containers of fixed capacity with documents, measured in tokens of a public tokenizer.

Documents are dealt out to shards of a bounded number of items by a hash of their id. Each shard starts from best fit
by decreasing size and then improves by local search: documents are moved, exchanged one for one or two for one
between underfull containers until no step makes the sum of squared fills grow, which empties the least full ones. What
is left in underfull containers goes through the same again, dealt out anew, until one shard holds it.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, release, spread

#: Where the vocabulary is, the capacity in tokens, and the most items that one task packs.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048
SHARD_ITEMS = 20_000
#: The pattern that parts a text before merging (a fixed value that belongs to this vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer, built once a worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens of every document; a null text has none. Texts are encoded whole. The vocabulary is a file of the
    driver; Spark sends it to the executors."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return spread(documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(count, "doc_id bigint, tokens bigint")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit by decreasing size: containers as lists of item numbers."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # sorted (free space, container)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(free, (size, -1))
        if at < len(free):
            room, b = free.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > size:
            bisect.insort(free, (room - size, b))
    return bins


def improve(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search between underfull containers. A step takes one or two items out of the emptier container and puts one
    or none of the fuller one's back: it is done if the fuller one gains, so that the sum of squared fills grows. Of all
    steps of a container the one of the largest gain is taken, into the fullest other. Ends when none is left anywhere.

    All containers are tried as the emptier one, each against the items of all others in one search, so a try costs one
    pass over the items; of equal sizes in a container one stands for all.
    """
    size = np.asarray(sizes, np.int64)
    where = np.empty(len(size), np.int64)
    fill = np.array([int(size[b].sum()) for b in bins], np.int64)
    for k, b in enumerate(bins):
        where[b] = k
    while True:
        steps = 0
        items = np.flatnonzero(fill[where] < capacity)  # what lies in full containers stays there
        items = items[np.argsort(where[items], kind="stable")]
        open_bins = np.unique(where[items])
        for src in open_bins[np.argsort(fill[open_bins], kind="stable")]:
            while 0 < fill[src] < capacity:
                step = _step(size, where, fill, items, open_bins, int(src), capacity)
                if step is None:
                    break
                out, back, dst = step
                where[out], where[back] = dst, src
                gain = int(size[out].sum() - size[back].sum())
                fill[src] -= gain
                fill[dst] += gain
                steps += 1
        if not steps:
            break
    order = np.argsort(where, kind="stable")
    return [b.tolist() for b in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(b)]


def _step(size: np.ndarray, where: np.ndarray, fill: np.ndarray, items: np.ndarray, open_bins: np.ndarray, src: int, capacity: int) -> tuple[list[int], list[int], int] | None:
    """(items out of src, items back into src, the container they go to) of the largest gain; None if there is none."""
    own = items[where[items] == src]
    single, first = np.unique(size[own], return_index=True)
    first = own[first]
    # What can be taken out: one item, or two of different or (if there are two) of equal size.
    i, j = np.triu_indices(len(single))
    twice = (i != j) | (np.bincount(np.searchsorted(single, size[own]), minlength=len(single))[i] > 1)
    i, j = i[twice], j[twice]
    total = np.concatenate([single, single[i] + single[j]])
    order = np.argsort(total, kind="stable")
    total = total[order]
    # Where it can go: in place of nothing or of one item, in a container that is at least as full and has room.
    into = np.concatenate([open_bins, where[items]])
    gone = np.concatenate([np.zeros(len(open_bins), np.int64), size[items]])
    which = np.concatenate([np.full(len(open_bins), -1), items])
    fits = (fill[into] < capacity) & (fill[into] >= fill[src]) & (into != src)
    into, gone, which = into[fits], gone[fits], which[fits]
    if not len(into):
        return None
    at = np.searchsorted(total, gone + (capacity - fill[into]), side="right") - 1
    gain = np.where(at >= 0, total[at] - gone, 0)
    best = int(np.lexsort((-fill[into], -gain))[0])
    if gain[best] <= 0:
        return None
    pick = int(order[at[best]])
    if pick < len(single):
        out = [int(first[pick])]
    else:
        a, b = i[pick - len(single)], j[pick - len(single)]
        out = [int(first[a]), int(own[size[own] == single[b]][-1])]
    return out, [int(which[best])] if which[best] >= 0 else [], int(into[best])


def _packer(capacity: int, level: int, last: bool):
    def pack(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        t = t.sort_by([("doc_id", "ascending"), ("part", "ascending")])
        sizes = np.asarray(t.column("size"))
        bins = improve(sizes, best_fit(sizes, capacity), capacity)
        label, full = [""] * len(sizes), [True] * len(sizes)
        for k, b in enumerate(bins):
            closed = last or int(sizes[b].sum()) * 100 >= capacity * 99
            for i in b:
                label[i], full[i] = f"{level}-{shard}-{k}", closed
        return pa.table({"container": pa.array(label, pa.string()), "doc_id": t.column("doc_id"), "part": t.column("part"), "size": t.column("size"), "closed": pa.array(full)})

    return pack


def pack_items(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """container, doc_id, part, size for items (doc_id, part, size), each of a size from 1 to capacity. Containers of which
    99 % are filled are closed; the items of the others are dealt out again, until they are one shard or none was closed."""
    done: list[DataFrame] = []
    todo, level, before = items, 0, -1

    while True:
        todo = cut(todo)
        n = todo.count()
        shards = max(1, -(-n // shard_items))
        last = shards == 1 or n == before

        # A number of partitions of their own: the rows are a few bytes, so adaptive execution would put all shards into one.
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part", F.lit(level)), F.lit(shards)).cast("int")).repartition(2 * shards, "shard")
        packed = cut(dealt.groupBy("shard").applyInArrow(_packer(capacity, level, last), "container string, doc_id bigint, part int, size bigint, closed boolean"))
        release(todo)
        done.append(packed.where("closed").drop("closed"))
        if last:
            break
        before, todo, level = n, packed.where(~F.col("closed")).select("doc_id", "part", "size"), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack(documents: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document and part: doc_id, part, tokens (of the part), container, unused (of the container).

    A text is whole (part 0) unless it alone exceeds the capacity: then it fills containers of its own, and what is left
    over is one more item. Null and empty texts take no room and no container (container null, unused null). Ids are
    expected to be unique; a repeated id is packed as often as it is there only if its rows differ in tokens.
    """
    counts = token_counts(documents, doc_id, text, vocabulary)
    counts = cut(counts)
    whole = F.floor(F.col("tokens") / capacity).cast("int")
    own = counts.where(F.col("tokens") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("part")).withColumn("size", F.lit(capacity).cast("bigint"))
    own = own.select(F.concat_ws("-", F.lit("own"), "doc_id", "part").alias("container"), "doc_id", F.col("part").cast("int").alias("part"), "size")
    items = counts.where(F.col("tokens") % capacity > 0).select("doc_id", whole.alias("part"), (F.col("tokens") % capacity).alias("size"))
    packed = pack_items(items, capacity).unionByName(own)
    used = packed.groupBy("container").agg((F.lit(capacity) - F.sum("size")).cast("bigint").alias("unused"))
    out = packed.join(used, "container").select("doc_id", "part", F.col("size").alias("tokens"), "container", "unused")
    none = counts.where("tokens = 0").select("doc_id", F.lit(0).cast("int").alias("part"), F.lit(0).cast("bigint").alias("tokens"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("bigint").alias("unused"))
    return out.unionByName(none)
