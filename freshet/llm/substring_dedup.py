"""Substring dedup: runs of ``WINDOW`` words that start more than once, by prefix-partitioned suffix trees.

``dedup(docs)`` gives every row its number of words, the number removed, and the text of the words kept;
a word goes if a window covers it whose words also start anywhere else, in the same document or in
another.  Words are runs without white space, unchanged.

The suffixes are those that start at the first word of a window.  Each is routed by a prefix of
variable length, which ends with the least run of ``GRAM`` words (by hash) that begins early enough to lie within
its first ``WINDOW`` words: equal windows have equal prefixes, and neighbouring suffixes mostly
share the run, so that one record of words carries all of them.

1.  Every document gives one seed for each run that ends prefixes: the run, a digest of its record, the place.
    The seeds are put in order of run and record in range slices (``operators.slices``), so that a frequent run
    is cut as well.  Equal records are one leaf of the run's subtree, and a leaf held by several places is a
    node as deep as the record: all its suffixes are repeats.  A run with one leaf is a single path; no words are sent for it.
2.  Of a run with other leaves and some that are held once, the words of each leaf are sent once, as a group that fits in
    memory.  Its suffixes are sorted; the common prefix of neighbours gives the internal nodes of the subtree, and the leaves
    below a node ``WINDOW`` words deep or deeper are repeats.  Groups are built many at a time, never cut.
3.  Suffixes of a run with more than ``GROUP`` leaves are split by the longest prefix, all ``WINDOW`` words, as
    a 128-bit digest.  There the node itself is the group, and what is left to know of it is a count, taken over range slices.

Equal texts are one class from the start: all windows of a class with several rows are repeats, and it takes
part once in the search.  NULL and empty texts have no words; nothing is removed from a text with fewer words than a
window.  Repeated rows are copies.  Rows with any id, NULL too, come out once each; other columns are not looked at.
Texts may be of any length; a task holds one at a time.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import slices
from ._common import arrow_batch, arrow_schema, documents, hash_words, mix, only, small_batches, stage

#: words of a window
WINDOW = 35
#: words of the run that ends a prefix
GRAM = 8
#: leaves that a subtree built in memory may have
GROUP = 4096
#: seeds of one range slice
SLICE_ROWS = 1_000_000
#: records of the subtrees built at once
AT_ONCE = 8192


def split(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``split`` of bytes cuts at exactly those characters."""
    return text.encode().split() if text else []


def prefixes(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(run's hash, its place, first suffix, last suffix) of the suffixes that share a run, in order."""
    if len(words) < window:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    h = hash_words(words)
    n = len(h) - gram + 1
    run = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(gram):
        run = mix(run * np.uint64(0x100000001B3) + h[i:i + n])
    # the least run of each window, the first of equal ones: the place is in the low half
    least = (run >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    width, reach = window - gram + 1, 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    return run[at[first]], at[first], first, last


_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _contents(words: list[bytes], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Digests of the runs of words from ``start`` to before ``stop``: polynomials of the words' hashes."""
    terms = mix(hash_words(words)) * _powers(_BASE, len(words))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    return mix((upto[stop] - upto[start]) * _powers(_BACK, len(words))[start] + (stop - start).astype(np.uint64))


def deep(rows: np.ndarray) -> np.ndarray:
    """Which suffixes, cut to a window, lie below an internal node as deep as the window."""
    n, depth = rows.shape
    keys = np.ascontiguousarray(rows.astype(">u4")).view(f"V{4 * depth}").ravel()
    order = np.argsort(keys, kind="stable")
    tree = rows[order]
    differ = tree[1:] != tree[:-1]
    common = np.where(differ.any(1), differ.argmax(1), depth)  # words shared with the suffix before
    node = common >= depth
    out = np.zeros(n, bool)
    out[order[1:][node]] = True
    out[order[:-1][node]] = True
    return out


#: a text's class: 96 bits of its SHA-256
CLASS = ["d1", "d2"]


def _with_class(docs: DataFrame, *others: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(text, 256)
    return docs.select(
        *others, F.conv(F.substring(digest, 1, 16), 16, -10).cast("long").alias("d1"),
        (F.conv(F.substring(digest, 17, 8), 16, 10).cast("long") - (1 << 31)).cast("int").alias("d2"), text.alias("text"))


def _seeds(batches, window: int, gram: int, out: pa.Schema):
    """Seeds of the texts of a task, of equal texts once."""
    only("words")
    seen = set()
    for b in batches:
        runs, contents, places, ones, twos = [], [], [], [], []
        for d1, d2, text in zip(*(c.to_pylist() for c in b.columns)):
            if (d1, d2) in seen:
                continue
            seen.add((d1, d2))
            words = split(text)
            run, at, first, last = prefixes(words, window, gram)
            if len(run):
                runs.append(run.view(np.int64))
                places.append(at.astype(np.int32))
                contents.append(_contents(words, first, last + window).view(np.int64))
                ones.append(np.full(len(run), d1, np.int64))
                twos.append(np.full(len(run), d2, np.int32))
        if contents:
            yield arrow_batch(out, [np.concatenate(runs), np.concatenate(contents), np.concatenate(ones),
                                    np.concatenate(twos), np.concatenate(places)])


def _chunks(rows, out: pa.Schema):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == AT_ONCE:
            yield arrow_batch(out, list(zip(*held)))
            held = []
    if held:
        yield arrow_batch(out, list(zip(*held)))


def _records(batches, window: int, gram: int, out: pa.Schema):
    """Of the places asked for: the record's words, or the full prefix of each of its suffixes."""
    import xxhash

    only("words")

    def rows():
        for b in batches:
            for d1, d2, text, asked in zip(*(c.to_pylist() for c in b.columns)):
                words = split(text)
                run, at, first, last = prefixes(words, window, gram)
                spots = np.searchsorted(at, [r["place"] for r in asked]).tolist()
                for i, r in zip(spots, asked):
                    low, high = int(first[i]), int(last[i])
                    if not r["many"]:
                        yield int(run[i].view(np.int64)), d1, d2, low, r["alone"], b" ".join(words[low:high + window]), None
                        continue
                    for p in range(low, high + 1):
                        yield None, d1, d2, p, r["alone"], None, xxhash.xxh3_128_digest(b" ".join(words[p:p + window]))

    yield from _chunks(rows(), out)


def _subtrees(batches, window: int, out: pa.Schema, at_once: int):
    """Ranges of repeated suffixes of the leaves held once, from records in order of their runs."""
    only()

    def build(records):
        numbers: dict = {}
        ids, sizes = [], []
        for words in records.column(5).to_pylist():
            row = [numbers.setdefault(w, len(numbers)) for w in words.split(b" ")]
            sizes.append(len(row) - window + 1)
            ids.append(row)
        sizes = np.array(sizes)
        flat = np.concatenate([np.array(r, np.uint32) for r in ids])
        record = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.cumsum(sizes) - sizes  # a record has window - 1 words more than suffixes
        inside = np.arange(len(record)) - begin[record]
        marked = deep(flat[(inside + (begin + np.arange(len(sizes)) * (window - 1))[record])[:, None] + np.arange(window)])
        marked &= records.column(4).to_numpy(zero_copy_only=False)[record]
        ahead = np.append(False, marked[:-1]) & (inside > 0)
        behind = np.append(marked[1:], False) & (inside < sizes[record] - 1)
        low, high = np.flatnonzero(marked & ~ahead), np.flatnonzero(marked & ~behind)
        taken = records.take(pa.array(record[low]))
        start = taken.column(3).to_numpy()
        return arrow_batch(out, [taken.column(1), taken.column(2), pa.nulls(len(low), pa.int32()), start + inside[low], start + inside[high]])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < at_once:
            continue
        rows = pa.concat_batches(held)
        run = rows.column(0).to_numpy()
        cut = int(np.searchsorted(run, run[-1]))  # the last run may go on in the next batch
        if cut:
            yield build(rows.slice(0, cut))
        held, n = [rows.slice(cut)], rows.num_rows - cut
    if n:
        yield build(pa.concat_batches(held))


def leaves(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The seeds that share a run with another one: run, class, place, alone, asked, n.

    alone   no other place holds the same record
    asked   one place of each leaf, in the runs where a subtree has to be built; these rows are apart from the others
    n       leaves of the run, of rows asked
    """
    schema = "run long, content long, d1 long, d2 int, place int"
    spark = docs.sparkSession
    seeds = stage(docs.mapInArrow(partial(_seeds, window=window, gram=gram, out=arrow_schema(schema)), schema), "seeds")
    n = max(spark.sparkContext.defaultParallelism, -(-seeds.count() // SLICE_ROWS))
    spot = ["content", *CLASS, "place"]
    cut = slices.cut(seeds, ["run"], spot, "seeds", n)
    rows = cut.select(slices.SLICE, "run", *spot).dropDuplicates()  # copies of other tasks
    rows = slices.neighbours(rows, ["run"], spot, ["content"], table=cut)
    rows = rows.where(F.col("before").isNotNull() | F.col("after").isNotNull())
    other = lambda side: F.coalesce(F.col(f"{side}.content") != F.col("content"), F.lit(True))
    shared = stage(rows.select("run", *CLASS, "place", other("before").alias("leader"), (other("before") & other("after")).alias("alone")),
                   "shared")
    runs = shared.groupBy("run").agg(F.sum(F.col("leader").cast("long")).alias("n"), F.max("alone").alias("some_alone"))
    # one plan at every size: a broadcast where the runs are few would only hide what the join shuffles
    built = shared.where("leader").join(runs.where("some_alone AND n > 1").hint("merge"), "run").select(
        "run", *CLASS, "place", "alone", F.lit(True).alias("asked"), "n")
    held = shared.where("NOT alone").select("run", *CLASS, "place", "alone", F.lit(False).alias("asked"), F.lit(0).cast("long").alias("n"))
    return stage(built.union(held), "leaves")


def repeats(docs: DataFrame, classes: DataFrame, *, window: int = WINDOW, gram: int = GRAM, group: int = GROUP,
            at_once: int = AT_ONCE) -> DataFrame:
    """(d1, d2, place, low, high): ranges of suffixes of a text, by its class, whose window starts elsewhere as well.

    A NULL range stands for all suffixes whose prefix ends at ``place``.
    """
    spark = docs.sparkSession
    found = leaves(docs, window=window, gram=gram)
    nothing = F.lit(None).cast("int")
    whole = found.where(~F.col("alone") & ~F.col("asked")).select(*CLASS, "place", nothing.alias("low"), nothing.alias("high"))

    places = found.where("asked").groupBy(*CLASS).agg(F.collect_list(F.struct(
        "place", "alone", (F.col("n") > group).alias("many"))).alias("places"))
    schema = "run long, d1 long, d2 int, first int, alone boolean, words binary, prefix binary"
    records = stage(classes.select(*CLASS, "text").join(places, CLASS).mapInArrow(
        partial(_records, window=window, gram=gram, out=arrow_schema(schema)), schema), "records")
    ranges = "d1 long, d2 int, place int, low int, high int"
    trees = (records.where("prefix IS NULL").drop("prefix").repartition("run").sortWithinPartitions("run")
             .mapInArrow(partial(_subtrees, window=window, out=arrow_schema(ranges), at_once=at_once), ranges))
    marks = whole.union(trees)
    suffixes = records.where("prefix IS NOT NULL").select("prefix", *CLASS, "first", "alone")
    n = -(-suffixes.count() // SLICE_ROWS)
    if n:
        cut = slices.cut(suffixes, ["prefix"], [*CLASS, "first"], "suffixes", max(n, spark.sparkContext.defaultParallelism))
        held = slices.group_totals(cut, ["prefix"], {"n": (F.sum, F.lit(1))}, cut)
        marks = marks.union(held.where((F.col("n") > 1) & F.col("alone")).select(*CLASS, nothing, "first", "first"))
    return marks


def _cleaned(batches, window: int, gram: int, out: pa.Schema, digest_only: bool):
    only("words")
    for b in batches:
        rows = []
        for d1, d2, text, n, marks in zip(*(c.to_pylist() for c in b.columns)):
            words = split(text)
            gone = np.zeros(len(words) + 1, np.int64)
            if len(words) >= window:
                if n > 1:
                    gone[0] = 1
                elif marks:
                    places = [m["place"] for m in marks if m["low"] is None]
                    ranges = [(m["low"], m["high"]) for m in marks if m["low"] is not None]
                    if places:
                        _, at, first, last = prefixes(words, window, gram)
                        spots = np.searchsorted(at, places)
                        ranges += zip(first[spots].tolist(), last[spots].tolist())
                    for low, high in ranges:
                        gone[low] += 1
                        gone[high + window] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            rows.append((d1, d2, len(words), int(gone.sum()),
                         hashlib.sha256(kept).hexdigest() if digest_only else kept.decode()))
        if rows:
            yield arrow_batch(out, list(zip(*rows)))


def dedup(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, group: int = GROUP,
          at_once: int = AT_ONCE, digest_only: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): one row per row of ``docs``; ``kept`` has the words joined by one space.

    digest_only   the lower-case SHA-256 of ``kept`` in its place, as ``kept_sha256``
    """
    if not gram <= window:
        raise ValueError("a run must fit in a window")
    small_batches(docs.sparkSession)
    texts = _with_class(docs)
    classes = texts.groupBy(*CLASS).agg(F.any_value("text").alias("text"), F.count("*").alias("n"))
    found = repeats(texts, classes, window=window, gram=gram, group=group, at_once=at_once)
    marks = found.groupBy(*CLASS).agg(F.collect_list(F.struct("place", "low", "high")).alias("marks"))
    kept = "kept_sha256" if digest_only else "kept"
    schema = f"d1 long, d2 int, n_words long, n_removed long, {kept} string"
    done = (classes.join(marks, CLASS, "left").select(*CLASS, "text", "n", "marks")
            .mapInArrow(partial(_cleaned, window=window, gram=gram, out=arrow_schema(schema), digest_only=digest_only), schema))
    return _with_class(docs, "doc_id").drop("text").join(done, CLASS).drop(*CLASS)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: what is left of every document."""
    return dedup(documents(spark, sf_dir), digest_only=True)


SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
keys AS (
  SELECT r, p, md5(array_to_string(ws[p:p + 34], ' ')) AS k
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS p FROM w WHERE len(ws) >= 35)),
twice AS (SELECT k FROM keys GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM keys WHERE k IN (SELECT k FROM twice)),
words AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""
