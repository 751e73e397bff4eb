"""A hierarchical Pitman-Yor language model of words, seated by Gibbs sampling over Spark tables.

Restaurants: every word that training texts have (and the start of a text) has one for the words that follow it, and all of them share
one parent, whose base is uniform over the known words and one unknown. A table of a word in a context restaurant is a customer of the parent.

Pairs of a context and a word have customers and tables, and so have contexts and words. A
sweep brings a context's tables and a word's parent probability to the rows with two customers or more, unseats and seats their customers anew, one by one,
given the rest of the restaurant as of the last sweep, and sums the new tables by context and by word; a single customer always has a table of its own and
is only counted. Beyond the 64th customer of a word in one restaurant they come in blocks of a sixteenth of those seated, whose new tables are their
expectation, rounded at random. The state after each sweep is stored; only sums come to the driver. Random numbers are functions of the words,
sweep and step. Predictive probabilities are averaged over the sweeps after ``burn_in``.

Pairs and words lie at places, packed: a line of a table holds all that a place sends to another, as compressed arrays in an order that both know, so a sweep
shuffles lines and not rows. Words are numbered by where they lie. All pairs of a context lie at one place, but for contexts with more tokens than a
place has on average; the tables of those (at most one a place) come to the driver as sums. A table takes the folder of one that is read no more.
``whole_model`` gives the same model as rows.

Scoring: documents are cut into chunks of about ``chunk_tokens`` tokens, stored as numbers. A chunk sends each of its distinct pairs of words once; customers,
tables and parent probabilities come back in the order sent, and the chunk sums its documents.

With ``contexts`` given, only that many of the most frequent words have a restaurant, and words after any other word are customers of the parent itself:
a smaller model whose rows are words, with the tables by context as vectors on the driver. The query does not use it.

Defined cases: null and empty texts are the end alone. Rows without an id are learned from and not held out. Repeated rows are learned from as
often as they occur, and scored each. Without training documents the only known mass is the unknown word: every score is 0.
An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import col, most_frequent, small_batches, stored, text_of
from scorelake.session import shared_dir

END = b"\n"  # No word has white space in it, so this is none.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def uniforms(keys: np.ndarray, *steps: int) -> np.ndarray:
    """A number from [0, 1) for each key and the given steps."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)
        for s in steps:
            z = (z ^ (np.uint64(s) + _MIX)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(29)
    return (z >> np.uint64(11)).astype(np.float64) / 2.0**53


def seated(counts: np.ndarray, strength: np.ndarray, discount: float, parent: np.ndarray, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each word after seating its ``counts`` customers anew. ``strength``: the restaurant's, with the tables of other words in it."""
    tables = np.minimum(counts, 1).astype(np.float64)
    several = np.flatnonzero(counts > 1)  # A single customer has a table of its own; most words have one.
    order = several[np.argsort(-counts[several], kind="stable")]
    c, a0, p, k, t, i = counts[order], strength[order], parent[order], keys[order], np.ones(len(order)), 1
    while (n := int(np.searchsorted(-c, -i, side="left"))) > 0:
        step = 1 if i < 64 else max(1, i // 16)
        new = (a0[:n] + discount * t[:n]) * p[:n]
        expected = np.minimum(step, c[:n] - i) * new / (new + i - discount * t[:n])
        t[:n] += np.floor(expected + uniforms(k[:n], sweep, i))
        i += step
    tables[order] = t
    return tables


class Settings:
    """What all words share: discounts, strengths, the numbers of words and of customers by context, and the sums after each sweep."""

    def __init__(self, known: int, discounts: tuple[float, float], customers: np.ndarray, strengths: tuple[float, float] = (1.0, 1.0)):
        self.base, self.customers = 1.0 / (known + 1), customers
        (self.d1, self.d2), (self.s1, self.s2) = discounts, strengths
        self.sums: list[np.ndarray] = []  # Tables by context, then tables and customers of the parent.

    def parent_probability(self, customers: np.ndarray, tables: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return (customers - self.d1 * tables + (self.s1 + self.d1 * sums[-2]) * self.base) / (self.s1 + sums[-1])

    def unknown(self, sums: np.ndarray) -> float:
        return float(self.parent_probability(np.zeros(1), np.zeros(1), sums)[0])

    def back_off(self, sums: np.ndarray) -> np.ndarray:
        """The mass of each context's restaurant that its parent gives; 1 for words after rare words (number 0)."""
        out = (self.s2 + self.d2 * sums[:-2]) / (self.s2 + self.customers)
        out[0] = 1.0
        return out


class Words:
    """A batch of word rows as arrays; ``owner`` is the row of each (word, context) pair."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column("pairs")
        pairs = lists.flatten()
        sizes = np.diff(lists.offsets.to_numpy())
        self.keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        self.alone = batch.column("alone").to_numpy(zero_copy_only=False).astype(np.float64)
        self.owner = np.repeat(np.arange(batch.num_rows), sizes)
        self.context = pairs.field("ctx").to_numpy(zero_copy_only=False).astype(np.int64)
        self.count = pairs.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
        self.sizes = sizes

    def parents(self, tables: np.ndarray) -> np.ndarray:
        return self.alone + np.bincount(self.owner, tables, minlength=len(self.alone))

    def sweeps(self, settings: Settings):
        """(tables by pair, customers and tables at the parent) at first, and after each sweep that the sums allow."""
        tables, top = np.ones(len(self.count)), np.ones(len(self.alone))
        customers = self.parents(tables)
        yield tables, customers, top
        pair_keys = self.keys[self.owner] + self.context.astype(np.uint64) * _MIX
        for sweep, sums in enumerate(settings.sums, 1):
            parent = settings.parent_probability(customers, top, sums)
            others = settings.s2 + settings.d2 * (sums[self.context] - tables)
            tables = seated(self.count, others, settings.d2, parent[self.owner], pair_keys, sweep)
            customers = self.parents(tables)
            rest = settings.s1 + settings.d1 * (sums[-2] - top)
            top = seated(customers.astype(np.int64), rest, settings.d1, np.full(len(top), settings.base), self.keys, sweep)
            yield tables, customers, top


# White space becomes a blank and A to Z small; the line feed is then free to stand for the end of a text.
_PLAIN = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Chunk:
    """Tokens of whole documents: ``ids`` of all tokens, the distinct ``words`` they number, and the documents' ``sizes`` in tokens with their ends."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" \n ".join(texts) + b" \n ", dtype=np.uint8)
        blank = raw == 32
        raw = raw[~(blank & np.concatenate(([True], blank[:-1])))]  # One blank behind every word, none before the first.
        starts = np.concatenate(([0], np.flatnonzero(raw == 32) + 1))
        kind = pa.binary() if len(raw) < 1 << 31 else pa.large_binary()
        offsets = starts.astype(np.int32 if kind == pa.binary() else np.int64)
        coded = pa.Array.from_buffers(kind, len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        end = raw[starts[:-1]] == 10
        self.end = int(self.ids[int(np.argmax(end))])
        self.sizes = np.diff(np.concatenate(([-1], np.flatnonzero(end))))
        words = coded.dictionary
        ends = np.frombuffer(words.buffers()[1], offsets.dtype)[words.offset:words.offset + len(words) + 1].astype(np.int64)
        data = np.delete(np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]], ends[1:] - ends[0] - 1)
        ends = (ends - ends[0] - np.arange(len(ends))).astype(offsets.dtype)
        self.words = pa.Array.from_buffers(kind, len(words), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())

    def contexts(self, numbers: dict[bytes, int]) -> np.ndarray:
        """The context number of each token: that of the token before, the end of a text standing for the start of the next."""
        listed = pc.index_in(self.words, value_set=pa.array(list(numbers), pa.binary())).fill_null(len(numbers)).to_numpy(zero_copy_only=False)
        of = np.array([*numbers.values(), 0], dtype=np.int64)[listed]
        return of[np.concatenate(([self.end], self.ids[:-1]))]

    def pairs(self) -> np.ndarray:
        """The word before and the word of each token, as one number; the end of a text stands for the start of the next."""
        return np.concatenate(([self.end], self.ids[:-1])) << 32 | self.ids


def _chunks(batches, chunk_tokens: int):
    """(tokens, ids, learned flags) for chunks of whole documents of about ``chunk_tokens`` tokens."""
    texts, names, learned, total = [], [], [], 0
    for batch in batches:
        for name, text, learn in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("learned").to_pylist()):
            texts.append(bytes(text.as_buffer()).translate(_PLAIN) if text.is_valid else b"")
            names.append(name)
            learned.append(learn)
            total += texts[-1].count(32) + 1
            if total >= chunk_tokens:
                yield Chunk(texts), names, np.array(learned)
                texts, names, learned, total = [], [], [], 0
    if texts:
        yield Chunk(texts), names, np.array(learned)


def word_counts(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """(word, n) over the learned rows; a task sends a word once for about ``chunk_tokens`` tokens."""
    def counts(batches):
        for chunk, _, _ in _chunks(batches, chunk_tokens):
            yield pa.RecordBatch.from_arrays([chunk.words, pa.array(np.bincount(chunk.ids, minlength=len(chunk.words)))], ["word", "n"])

    return docs.where("learned").select("doc_id", "text", "learned").mapInArrow(counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, numbers: dict[bytes, int], chunk_tokens: int) -> DataFrame:
    """(word, n, alone, key, pairs): the row of each word. A list of pairs has one entry a context at most."""
    def counts(batches):
        for chunk, _, learned in _chunks(batches, chunk_tokens):
            pick = np.repeat(learned, chunk.sizes)
            both = np.sort((chunk.ids << 16 | chunk.contexts(numbers))[pick])
            at = np.flatnonzero(np.diff(both, prepend=-1))
            words = chunk.words.take(pa.array(both[at] >> 16))
            n = np.diff(np.append(at, len(both)))
            yield pa.RecordBatch.from_arrays([words, pa.array((both[at] & 65535).astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "ctx", "n"])

    each = docs.mapInArrow(counts, "word binary, ctx int, n long").groupBy("word", "ctx").agg(F.sum("n").alias("n"))
    return each.groupBy("word").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("ctx") == 0, F.col("n")).otherwise(0)).alias("alone"),
        F.sort_array(F.collect_list(F.when(F.col("ctx") > 0, F.struct("ctx", "n")))).alias("pairs"),
    ).withColumn("key", F.xxhash64("word"))


def _discount(row, ones: str, twos: str) -> float:
    """The usual estimate from the numbers of things seen once and twice."""
    return float(min(0.95, max(0.05, (row[ones] or 0) / max(1, (row[ones] or 0) + 2 * (row[twos] or 0)))))


def learned_model(docs: DataFrame, contexts: int, burn_in: int, samples: int, chunk_tokens: int) -> tuple[DataFrame, Settings, dict[bytes, int], dict]:
    """The stored word rows, the settings with the sums of all sweeps, the context numbers, and totals."""
    counts = stored(word_counts(docs, chunk_tokens), "word-counts")
    total = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("known"), F.sum((F.col("n") == 1).cast("long")).alias("ones"), F.sum((F.col("n") == 2).cast("long")).alias("twos")).first()
    top = most_frequent(counts.where(F.col("word") != F.lit(END)), contexts)
    numbers = {END: 1} | {bytes(row["word"]): i for i, row in enumerate(top, 2)}
    rows = stored(pair_counts(docs, numbers, chunk_tokens), "word-rows")
    pairs = rows.select(F.explode("pairs").alias("p")).groupBy("p.ctx").agg(
        F.sum("p.n").alias("n"), F.sum((F.col("p.n") == 1).cast("long")).alias("ones"), F.sum((F.col("p.n") == 2).cast("long")).alias("twos")).collect()
    customers = np.zeros(len(numbers) + 1)
    for row in pairs:
        customers[row["ctx"]] = row["n"]
    once = {k: sum(r[k] for r in pairs) for k in ("ones", "twos")}
    settings = Settings(total["known"], (_discount(total, "ones", "twos"), _discount(once, "ones", "twos")), customers)
    for _ in range(burn_in + samples + 1):
        def sums(batches, settings=settings):
            out = np.zeros(len(settings.customers) + 2)
            for batch in batches:
                if batch.num_rows:
                    words = Words(batch)
                    *_, (tables, heads, tops) = words.sweeps(settings)
                    out[:-2] += np.bincount(words.context, tables, minlength=len(out) - 2)
                    out[-2:] += tops.sum(), heads.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["at", "value"])

        got = rows.select("key", "alone", "pairs").mapInArrow(sums, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        vector = np.zeros(len(customers) + 2)
        for row in got:
            vector[row["at"]] = row["value"]
        settings.sums.append(vector)
    return rows, settings, numbers, {"tokens": total["tokens"] or 0, "known": total["known"]}


def predictive(rows: DataFrame, settings: Settings, burn_in: int) -> DataFrame:
    """(word, n, top, ctxs, probs): a word's parent probability for each sample, and its averaged probabilities in the contexts that saw it."""
    def of(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words, tops, seen = Words(batch), [], 0.0
            # The last sums belong to the last state; the state after sweep k has sums[k].
            kept = Settings(1, (settings.d1, settings.d2), settings.customers)
            kept.base, kept.sums = settings.base, settings.sums[:-1]
            for sweep, (tables, heads, top) in enumerate(words.sweeps(kept)):
                if sweep <= burn_in:
                    continue
                sums = settings.sums[sweep]
                tops.append(settings.parent_probability(heads, top, sums))
                own = (words.count - settings.d2 * tables) / (settings.s2 + settings.customers[words.context])
                seen = seen + own + settings.back_off(sums)[words.context] * tops[-1][words.owner]
            ends = np.concatenate(([0], np.cumsum(words.sizes))).astype(np.int32)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            flat = np.stack(tops, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"),
                 pa.ListArray.from_arrays(pa.array((np.arange(len(flat) + 1) * flat.shape[1]).astype(np.int32)), pa.array(flat.ravel())),
                 lists(words.context.astype(np.int32)), lists(seen / len(tops))], ["word", "n", "top", "ctxs", "probs"])

    return rows.mapInArrow(of, "word binary, n long, top array<double>, ctxs array<int>, probs array<double>")


def _labels(names: list) -> bytes:
    """Ids of a chunk's documents, then which of them are known."""
    known = np.array([n is not None for n in names])
    return np.where(known, [n or 0 for n in names], 0).astype("<i8").tobytes() + known.tobytes()


def occurrences(docs: DataFrame, numbers: dict[bytes, int], chunk_tokens: int) -> DataFrame:
    """(chunk, word, ctx, doc, names): a chunk's distinct words, with context and document number of each occurrence as packed arrays.
    The row of the end, which every document has once, carries the documents' ids."""
    def packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.itemsize).astype("<i4")), pa.py_buffer(values)])

    def rows(batches):
        for number, (own, names, _) in enumerate(_chunks(batches, chunk_tokens)):
            # Sorted by word, then place: the place is in the low bits, so plain numbers are sorted.
            order = np.sort(own.ids << 32 | np.arange(len(own.ids))) & 0xFFFFFFFF
            offsets = np.concatenate(([0], np.cumsum(np.bincount(own.ids, minlength=len(own.words)))))
            ctx = own.contexts(numbers)[order].astype("<u2")
            doc = np.repeat(np.arange(len(own.sizes), dtype="<u4"), own.sizes)[order]
            chunk = TaskContext.get().partitionId() << 32 | number
            labels = [None] * len(own.words)
            labels[own.end] = _labels(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(own.words), pa.int64()), own.words, packed(ctx, offsets), packed(doc, offsets), pa.array(labels, pa.binary())],
                ["chunk", "word", "ctx", "doc", "names"])

    return docs.mapInArrow(rows, "chunk long, word binary, ctx binary, doc binary, names binary")


def _joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The packed arrays of a column without nulls end to end, and the length of each."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, "<i4")[column.offset:column.offset + len(column) + 1]
    item = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind), np.diff(ends) // item


SUMS = "chunk long, names binary, doc binary, tokens binary, known binary, base binary, score binary"


def _summed(held: list) -> pa.RecordBatch:
    """Sums by document of (chunk, document, known, base, score) by occurrence, packed by chunk."""
    chunk, doc, known, base, score = (np.concatenate(x) for x in zip(*held))
    chunks, number = np.unique(chunk, return_inverse=True)
    order = np.argsort(number << 32 | doc)
    keys = (number << 32 | doc)[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    sums = [np.diff(np.append(first, len(keys))), *[np.add.reduceat(w[order], first) for w in (known, base, score)]]
    keys = keys[first]
    both = chunks[keys >> 32], keys & 0xFFFFFFFF
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(both[0])) + 1, [len(keys)]))
    kinds = ("<u4", "<u4", "<u4", "<f8", "<f8")
    columns = [[np.asarray(v[a:b]).astype(k).tobytes() for a, b in zip(cuts[:-1], cuts[1:])] for v, k in zip((both[1], *sums), kinds)]
    n = len(cuts) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(both[0][cuts[:-1]]), pa.nulls(n, pa.binary()), *[pa.array(c, pa.binary()) for c in columns]], [c.split()[0] for c in SUMS.split(", ")])


def _names_of(batch: pa.RecordBatch):
    named = batch.filter(pa.array(~np.asarray(batch.column("names").is_null())))
    if named.num_rows:
        yield pa.RecordBatch.from_arrays([named.column("chunk"), named.column("names"), *[pa.nulls(named.num_rows, pa.binary())] * 5], [c.split()[0] for c in SUMS.split(", ")])


def partial_scores(matched: DataFrame, settings: Settings, burn_in: int, totals: dict, most_held: int = 2_000_000) -> DataFrame:
    """Sums by document, packed by chunk; what is held between batches is at most ``most_held`` occurrences and a batch."""
    samples = settings.sums[burn_in + 1:]
    contexts = len(settings.customers)
    back = [settings.back_off(s) for s in samples]
    unknown = np.array([settings.unknown(s) for s in samples])
    denominator = totals["tokens"] + totals["known"] + 1

    def of(batches):
        held, size = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            ctx, sizes = _joined(batch.column("ctx"), "<u2")
            doc, _ = _joined(batch.column("doc"), "<u4")
            row = np.repeat(np.arange(batch.num_rows), sizes)
            count = batch.column("n").fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.tile(unknown, (batch.num_rows, 1))
            tops = batch.column("top")
            has = ~np.asarray(tops.is_null())
            if has.any():
                top[has] = np.asarray(tops.flatten()).reshape(-1, len(unknown))
            p = sum(b[ctx] * np.ascontiguousarray(t)[row] for b, t in zip(back, top.T)) / len(back)
            lists, probs = batch.column("ctxs"), np.asarray(batch.column("probs").flatten())
            after = np.flatnonzero(ctx)
            if len(probs) and len(after):
                lengths = np.zeros(batch.num_rows, dtype=np.int64)
                lengths[has] = np.asarray(lists.drop_null().value_lengths())
                keys = np.repeat(np.arange(batch.num_rows), lengths) * contexts + np.asarray(lists.flatten())
                want = row[after] * contexts + ctx[after]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                p[after[hit]] = probs[at[hit]]
            chunk = batch.column("chunk").to_numpy(zero_copy_only=False)
            held.append((chunk[row], doc.astype(np.int64), (count > 0)[row].astype(np.float64), np.log10((count + 1) / denominator)[row], np.log10(p)))
            size += len(row)
            yield from _names_of(batch)
            if size >= most_held:
                yield _summed(held)
                held, size = [], 0
        if held:
            yield _summed(held)

    return matched.mapInArrow(of, SUMS)


def every_pair(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """(ctx, word, n): each pair of words that follow one another in any text, and how often they do in learned ones."""
    def counts(batches):
        for chunk, _, learned in _chunks(batches, chunk_tokens):
            both = np.sort(chunk.pairs() << 1 | np.repeat(learned, chunk.sizes))
            at = np.flatnonzero(np.diff(both >> 1, prepend=-1))
            n = np.add.reduceat(both & 1, at)
            ctx, word = both[at] >> 33, both[at] >> 1 & 0xFFFFFFFF
            yield pa.RecordBatch.from_arrays([chunk.words.take(pa.array(ctx)), chunk.words.take(pa.array(word)), pa.array(n)], ["ctx", "word", "n"])

    return docs.mapInArrow(counts, "ctx binary, word binary, n long").groupBy("ctx", "word").agg(F.sum("n").alias("n"))


def _seat(df: DataFrame, settings: Settings, sweep: int, top: bool) -> DataFrame:
    """``t`` of rows (key, n, rest, p, t): the tables of ``n`` customers seated anew beside ``rest`` tables, given the tables ``t`` of before."""
    strength, discount = (settings.s1, settings.d1) if top else (settings.s2, settings.d2)

    def of(batches):
        for batch in batches:
            n, rest, p, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "rest", "p", "t"))
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            new = seated(n.astype(np.int64), strength + discount * (rest - t), discount, p, keys, sweep)
            yield batch.set_column(batch.schema.get_field_index("t"), "t", pa.array(new)).drop_columns(["rest", "p", "key"])

    left = df.drop("rest", "p", "key").schema
    return df.mapInArrow(of, left)


def whole_model(docs: DataFrame, burn_in: int, samples: int, chunk_tokens: int) -> tuple[DataFrame, DataFrame, DataFrame, Settings, dict]:
    """Restaurants for all contexts: rows of pairs (ctx, word, n, t), contexts (ctx, c, back_<i>) and words (word, n, prob_<i>), settings and totals.

    ``t`` are a pair's tables, ``back_<i>`` the mass that a context gives to the parent and ``prob_<i>`` a word's probability there, the first averaged over the
    samples, the others for each. Pairs and words that only other texts have are among them, with no customers.
    """
    pairs = stored(every_pair(docs, chunk_tokens), "pairs")
    seen = lambda k: F.count_if(F.col("n") == k)
    words = stored(pairs.groupBy("word").agg(
        F.sum("n").alias("count"), seen(1).cast("double").alias("singles"), F.count_if(F.col("n") > 0).cast("double").alias("n")
    ).withColumn("t", F.least("n", F.lit(1.0))), "words")
    contexts = stored(pairs.groupBy("ctx").agg(
        F.sum("n").alias("c"), seen(1).cast("double").alias("singles"), F.count_if(F.col("n") > 0).cast("double").alias("tables")), "contexts")
    numbers = lambda: [F.sum("t").alias("t"), F.sum("n").alias("n")]
    total = words.agg(F.sum("count").alias("tokens"), F.count_if(F.col("count") > 0).alias("known"), F.count_if(F.col("count") == 1).alias("ones"), F.count_if(F.col("count") == 2).alias("twos"), *numbers()).first()
    settings = Settings(total["known"], (_discount(total, "ones", "twos"), _discount(pairs.agg(seen(1).alias("ones"), seen(2).alias("twos")).first(), "ones", "twos")), np.zeros(0))
    settings.sums.append([total["t"] or 0.0, total["n"] or 0.0])
    several = pairs.where("n > 1").select("ctx", "word", "n", F.lit(1.0).alias("t"), F.lit(0.0).alias("all"))
    back = (settings.s2 + settings.d2 * F.col("tables")) / (settings.s2 + F.col("c"))
    for sweep in range(1, burn_in + samples + 1):
        sums, sample = settings.sums[-1], sweep - burn_in - 1
        parent = words.select("word", settings.parent_probability(F.col("n"), F.col("t"), sums).alias("p"))
        near = several.join(contexts.select("ctx", F.col("tables").alias("rest")), "ctx").join(parent, "word").withColumn("key", F.xxhash64("ctx", "word"))
        several = stored(_seat(near, settings, sweep, False).withColumn("all", F.col("all") + (F.col("t") if sample >= 0 else 0.0)), "seats")
        by = lambda key: several.groupBy(key).agg(F.sum("t").alias("sum"))  # noqa: B023, E731
        contexts = contexts.join(by("ctx"), "ctx", "left").withColumn("tables", F.col("singles") + F.coalesce("sum", F.lit(0.0))).drop("sum")
        contexts = stored(contexts.withColumn(f"back_{sample}", back) if sample >= 0 else contexts, "contexts")
        heads = words.join(by("word"), "word", "left").withColumn("n", F.col("singles") + F.coalesce("sum", F.lit(0.0))).drop("sum").withColumns(
            {"key": F.xxhash64("word"), "rest": F.lit(sums[0]), "p": F.lit(settings.base)})
        words = stored(_seat(heads, settings, sweep, True), "words")
        row = words.agg(*numbers()).first()
        settings.sums.append([row["t"] or 0.0, row["n"] or 0.0])
        if sample >= 0:
            words = words.withColumn(f"prob_{sample}", settings.parent_probability(F.col("n"), F.col("t"), settings.sums[-1]))
    single = pairs.where("n < 2").withColumn("t", F.col("n").cast("double"))
    pairs = single.unionByName(several.select("ctx", "word", "n", (F.col("all") / samples).alias("t")))
    words = words.select("word", F.col("count").alias("n"), *[f"prob_{i}" for i in range(samples)])
    return pairs, contexts.drop("singles", "tables"), words, settings, {"tokens": total["tokens"] or 0, "known": total["known"]}


def pair_probabilities(pairs: DataFrame, contexts: DataFrame, words: DataFrame, settings: Settings, samples: int) -> DataFrame:
    """(ctx, word, n, p): the count of the word and its averaged probability after the context."""
    own = (F.col("n") - settings.d2 * F.col("t")) / (settings.s2 + F.col("c"))
    given = sum((F.col(f"back_{i}") * F.col(f"prob_{i}") for i in range(samples)), F.lit(0.0)) / samples
    return pairs.join(contexts, "ctx").join(words.withColumnRenamed("n", "count"), "word").select("ctx", "word", F.col("count").alias("n"), (own + given).alias("p"))


# Tables of the whole model: a line goes to the place that works on it, from another one, with packed arrays and totals that are summed over all lines.
LINES = "kind string, place long, other long, arrays array<binary>, totals array<double>"
_LINE = pa.schema([("kind", pa.string()), ("place", pa.int64()), ("other", pa.int64()), ("arrays", pa.list_(pa.binary())), ("totals", pa.list_(pa.float64()))])
_LOW = 38  # Bits of a word's number.


def pack(values, kind: str = "i8") -> bytes:
    """Numbers as bytes of one place each, compressed: small numbers and repeats take little."""
    raw = np.ascontiguousarray(values, dtype="<" + kind)
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T)
    return kind.encode() + len(raw).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(raw) else b"")


def unpack(data: bytes) -> np.ndarray:
    kind, n = np.dtype("<" + data[:2].decode()), int.from_bytes(data[2:10], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[10:], n * kind.itemsize, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel()


def _ints(data: bytes) -> np.ndarray:
    return unpack(data).astype(np.int64)


def _pack_texts(texts: list[bytes]) -> tuple[bytes, bytes]:
    return pack([len(t) for t in texts], "u4"), pack(np.frombuffer(b"".join(texts), np.uint8), "u1")


def _texts(lengths: bytes, data: bytes) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(_ints(lengths))))
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(unpack(data))])


def _line(kind: str, place: int, other: int, arrays, totals=()) -> dict:
    return {"kind": kind, "place": int(place), "other": int(other), "arrays": list(arrays), "totals": [float(t) for t in totals]}


def _split(places: np.ndarray):
    """(place, which elements go there), in their order."""
    order = np.argsort(places, kind="stable")
    at = places[order]
    cuts = [*np.flatnonzero(np.diff(at, prepend=-1)), len(at)]
    return ((int(at[a]), order[a:b]) for a, b in zip(cuts[:-1], cuts[1:]))


def _sent(lines: DataFrame, of) -> DataFrame:
    """The lines that ``of`` makes of each line."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from pa.Table.from_pylist(of(row), _LINE).to_batches()

    return lines.mapInArrow(run, LINES)


def _met(lines: DataFrame, of) -> DataFrame:
    """The lines that ``of`` makes of all lines of a place."""
    return lines.groupBy("place").applyInArrow(lambda t: pa.Table.from_pylist(of(sorted(t.to_pylist(), key=lambda r: r["other"])), _LINE), LINES)


def _answered(states: DataFrame, lines: DataFrame, of, schema: str = LINES) -> DataFrame:
    """What ``of`` makes of a place's state and the lines to it."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = of(left.to_pylist()[0], sorted(right.to_pylist(), key=lambda r: (r["kind"], r["other"])))
        return out if isinstance(out, pa.Table) else pa.Table.from_pylist(out, _LINE)

    return states.groupBy("place").cogroup(lines.groupBy("place")).applyInArrow(run, schema)


def _kind(lines: DataFrame, kind: str) -> DataFrame:
    return lines.where(F.col("kind") == kind)


def _back(lines: DataFrame) -> DataFrame:
    """The lines on their way back."""
    return lines.select("kind", F.col("other").alias("place"), F.col("place").alias("other"), "arrays", "totals")


def _totals(lines: DataFrame) -> list[float]:
    rows = lines.select(F.posexplode("totals").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    return [r["value"] for r in rows]


class Slots:
    """Stored lines in named folders; a name that is used again takes the place of what it held. Shuffle files go as soon as the lines are stored."""

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark):
        self.spark, self.base = spark, shared_dir(spark, "pitman-yor")

    def kept(self, lines: DataFrame, name: str) -> DataFrame:
        path, before = f"{self.base}/{name}", self.spark.conf.get(self.CLEANUP, "false")
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            lines.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(self.CLEANUP, before)
        return self.spark.read.schema(LINES).parquet(path)


def chunk_lines(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """A line for each chunk: tokens, sizes, learned flags, ids of the documents, words."""
    def of(batches):
        for number, (own, names, learned) in enumerate(_chunks(batches, chunk_tokens)):
            arrays = [pack(own.ids, "u4"), pack(own.sizes, "u4"), pack(learned, "u1"), _labels(names), *_pack_texts(own.words.to_pylist())]
            line = _line("chunk", TaskContext.get().partitionId() << 32 | number, 0, arrays, [len(own.ids)])
            yield from pa.Table.from_pylist([line], _LINE).to_batches()

    return docs.mapInArrow(of, LINES)


def _key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def _places(words: list[bytes], parts: int) -> np.ndarray:
    return np.array([_key(w) % parts for w in words], dtype=np.int64)


def numbered(chunks: DataFrame, parts: int, slots: Slots) -> tuple[DataFrame, DataFrame]:
    """Lines of words and of chunks: a word's number is its row at its place, times ``parts``, plus the place; chunks have them in place of the words."""
    def counted(row):
        a = row["arrays"]
        words = _texts(a[4], a[5]).to_pylist()
        n = np.bincount(_ints(a[0])[np.repeat(unpack(a[2]) > 0, _ints(a[1]))], minlength=len(words))
        return [_line("word", q, row["place"], [pack(n[at], "u4"), *_pack_texts([words[i] for i in at])]) for q, at in _split(_places(words, parts))]

    def named(rows):
        parts_of = [_texts(*r["arrays"][1:]) for r in rows]
        coded = pa.concat_arrays(parts_of).dictionary_encode()
        row, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        count = np.bincount(row, np.concatenate([_ints(r["arrays"][0]) for r in rows]), len(words)).astype(np.int64)
        ends = np.cumsum([len(p) for p in parts_of])
        state = [pack(count), pack([_key(w) for w in words], "u8"), *_pack_texts(words)]
        totals = [count.sum(), (count > 0).sum(), (count == 1).sum(), (count == 2).sum()]
        return [_line("words", rows[0]["place"], 0, state, totals)] + [
            _line("number", r["other"], r["place"], [pack(row[b - len(p):b], "u4")]) for r, p, b in zip(rows, parts_of, ends)]

    def attached(left, right):
        a = left["arrays"]
        places = _places(_texts(a[4], a[5]).to_pylist(), parts)
        ids = np.zeros(len(places), dtype=np.int64)
        for (q, at), r in zip(_split(places), right, strict=True):
            ids[at] = _ints(r["arrays"][0]) * parts + q
        return [_line("chunk", left["place"], 0, [*a[:4], pack(ids)])]

    words = slots.kept(_met(_sent(chunks, counted), named), "words")
    return words, slots.kept(_answered(chunks, _kind(words, "number"), attached), "chunks")


class ChunkPairs:
    """A chunk's distinct pairs of words: ``order`` sorts its tokens by pair, ``first`` is where each begins there, ``place`` where it is counted.
    The pairs of a ``hot`` context are counted at many places, those of any other one at one."""

    def __init__(self, arrays: list[bytes], parts: int, hot: np.ndarray):
        self.tokens, self.sizes, self.ids = _ints(arrays[0]), _ints(arrays[1]), _ints(arrays[4])
        both = np.concatenate(([self.tokens[self.sizes[0] - 1]], self.tokens[:-1])) << 32 | self.tokens
        self.order = np.argsort(both, kind="stable")
        both = both[self.order]
        self.first = np.flatnonzero(np.diff(both, prepend=-1))
        both = both[self.first]
        self.own = both & 0xFFFFFFFF
        self.ctx, self.word = self.ids[both >> 32], self.ids[self.own]
        salt = np.where(np.isin(self.ctx, hot), self.word, 0).astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (self.ctx.astype(np.uint64) * _MIX ^ salt * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x94D049BB133111EB)
        self.place = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)

    def runs(self, at: np.ndarray) -> np.ndarray:
        """Where the pairs of a context begin among those of a place."""
        return np.flatnonzero(np.diff(self.ctx[at], prepend=-1))


def _rows_of(sums: list[np.ndarray], at: list[np.ndarray], size: int) -> np.ndarray:
    return np.bincount(np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0), *sums]), size).astype(np.int64)


class PairState:
    """What a place knows of its pairs with two customers or more: number of the context and of the word here, customers ``n``, tables ``t``, key; of its contexts
    the pairs with one customer and all customers, and which of them are hot; the words asked for, by place and row; the tables of each sample."""

    NAMES = ("ci", "wi", "n", "t", "key", "singles", "c", "hot_at", "hot", "asked", "kept", "home")

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    @classmethod
    def read(cls, line: dict):
        return cls(**{k: unpack(a) if k == "key" else _ints(a) for k, a in zip(cls.NAMES, line["arrays"])})

    def tables(self, t: np.ndarray, elsewhere: np.ndarray | None = None) -> np.ndarray:
        """Tables by context; ``elsewhere``: of the hot contexts, all places together."""
        out = (self.singles + np.bincount(self.ci, t, len(self.singles))).astype(np.float64)
        if elsewhere is not None:
            out[self.hot_at] = elsewhere[self.hot]
        return out

    def lines(self, place: int, n_hot: int, totals=()) -> list[dict]:
        here = np.zeros(n_hot)
        here[self.hot] = self.tables(self.t)[self.hot_at]
        return [_line("pairs", place, 0, [pack(getattr(self, k), "u8" if k == "key" else "i8") for k in self.NAMES], [*totals, *here])]


def counted_pairs(chunks: DataFrame, parts: int, hot: np.ndarray, hot_counts: np.ndarray, slots: Slots) -> DataFrame:
    """Lines of pairs; of words asked for; and for each chunk the customers of its pairs, and which of a place's pairs and contexts they are."""
    def sent(row):
        own = ChunkPairs(row["arrays"], parts, hot)
        learned = np.repeat(unpack(row["arrays"][2]), own.sizes).astype(np.int64)
        n, out = np.add.reduceat(learned[own.order], own.first), []
        for p, at in _split(own.place):
            start = own.runs(at)
            out.append(_line("pair", p, row["place"], [pack(own.ctx[at][start]), pack(np.diff(np.append(start, len(at))), "u4"), pack(own.word[at]), pack(n[at], "u4")]))
        return out

    def home(number):
        return number % parts << _LOW | number // parts

    def met(rows):
        place, got = rows[0]["place"], [[_ints(a) for a in r["arrays"]] for r in rows]
        ctxs, run_ci = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        both = np.repeat(run_ci, np.concatenate([g[1] for g in got])) << _LOW | np.concatenate([g[2] for g in got])
        both, at = np.unique(both, return_inverse=True)
        n = np.bincount(at, np.concatenate([g[3] for g in got])).astype(np.int64)
        ci, word = both >> _LOW, home(both & (1 << _LOW) - 1)
        several = n > 1
        hot_at = np.flatnonzero(np.isin(ctxs, hot))
        number = np.searchsorted(hot, ctxs[hot_at])
        c = np.bincount(ci, n, len(ctxs)).astype(np.int64)
        c[hot_at] = hot_counts[number]
        asked = np.unique(np.concatenate([word[several], home(ctxs[np.unique(ci[several])])]))
        state = PairState(
            ci=ci[several], wi=np.searchsorted(asked, word[several]), n=n[several], t=np.ones(int(several.sum()), np.int64), key=np.zeros(0, np.uint64),
            singles=np.bincount(ci[n == 1], minlength=len(ctxs)), c=c, hot_at=hot_at, hot=number, asked=asked, kept=np.zeros(0, np.int64), home=np.searchsorted(asked, home(ctxs)))
        words = np.unique(np.concatenate([word[n > 0], asked]))
        single = np.bincount(np.searchsorted(words, word[n == 1]), minlength=len(words))
        more = np.bincount(np.searchsorted(words, word[several]), minlength=len(words))
        wanted = np.isin(words, asked)
        out = state.lines(place, len(hot), [(n == 1).sum(), (n == 2).sum()])
        out += [_line("ask", q, place, [pack(words[i] & (1 << _LOW) - 1), pack(more[i]), pack(single[i]), pack(wanted[i], "u1")]) for q, i in _split(words >> _LOW)]
        row, end, run_end = np.cumsum(several) - 1, 0, 0
        for r, g in zip(rows, got):
            mine, runs = at[end:end + len(g[2])], run_ci[run_end:run_end + len(g[0])]
            out.append(_line("index", place, r["other"], [pack(n[mine]), pack(row[mine[n[mine] > 1]], "u4"), pack(runs, "u4")]))
            end, run_end = end + len(mine), run_end + len(runs)
        return out

    return slots.kept(_met(_sent(chunks, sent), met), "tokens")  # The words as texts are read no more.


def _pair_sweep(settings: Settings, elsewhere: np.ndarray, sweep: int, sample: bool):
    sums = settings.sums[-1]

    def of(left, right):
        s, got = PairState.read(left), [r["arrays"] for r in right]
        customers, top = (np.concatenate([np.zeros(0, np.int64), *[_ints(g[k]) for g in got]]) for k in (0, 1))
        if sweep == 1:  # The key of a pair is Spark's xxhash64 of both words.
            keys = np.concatenate([np.zeros(0, np.uint64), *[unpack(g[2]) for g in got]])
            texts = [t for g in got for t in _texts(g[3], g[4]).to_pylist()]
            seeds = keys[s.home[s.ci]].tolist() if len(s.ci) else []
            s.key = np.array([xxhash.xxh64_intdigest(texts[w], seed) for w, seed in zip(s.wi.tolist(), seeds)], dtype=np.uint64)
        parent = settings.parent_probability(customers, top, sums)
        rest = s.tables(s.t, elsewhere)[s.ci] - s.t
        s.t = seated(s.n, settings.s2 + settings.d2 * rest, settings.d2, parent[s.wi], s.key, sweep).astype(np.int64)
        if sample:
            s.kept = np.concatenate([s.kept, s.t])
        by_word = np.bincount(s.wi, s.t, len(s.asked))
        return s.lines(left["place"], len(elsewhere)) + [
            _line("ask", q, left["place"], [pack(s.asked[i] & (1 << _LOW) - 1), pack(by_word[i])]) for q, i in _split(s.asked >> _LOW)]

    return of


def _word_sweep(settings: Settings, sweep: int, sample: bool):
    """Sweep 0 counts the single customers, seats everyone at one table, and answers with the words themselves."""
    total = settings.sums[-1][0] if sweep else 0

    def of(left, right):
        a, got = left["arrays"], [r["arrays"] for r in right]
        rows = [_ints(g[0]) for g in got]
        if sweep:
            count, keys, singles, _, top, *kept = a
            singles, top, kept = _ints(singles), _ints(top), [_ints(k) for k in kept]
        else:
            count, keys, texts = a[0], a[1], _texts(a[2], a[3])
            singles, kept = _rows_of([_ints(g[2]) for g in got], rows, len(texts)), [np.zeros(0, np.int64)] * 2
        customers = singles + _rows_of([_ints(g[1]) for g in got], rows, len(singles))
        if sweep:
            base = np.full(len(top), settings.base)
            top = seated(customers, settings.s1 + settings.d1 * (total - top), settings.d1, base, unpack(keys), sweep).astype(np.int64)
        else:
            top = np.minimum(customers, 1)
        if sample:
            kept = [np.concatenate([k, new]) for k, new in zip(kept, (customers, top))]
        out = [_line("words", left["place"], 0, [count, keys, *[pack(x) for x in (singles, customers, top, *kept)]], [top.sum(), customers.sum()])]
        for r, g, at in zip(right, got, rows):
            at = at if sweep else at[unpack(g[3]) > 0]
            more = [] if sweep else [pack(unpack(keys)[at], "u8"), *_pack_texts(texts.take(pa.array(at)).to_pylist())]
            out.append(_line("answer", r["other"], left["place"], [pack(customers[at]), pack(top[at]), *more]))
        return out

    return of


def packed_scores(docs: DataFrame, burn_in: int, samples: int, chunk_tokens: int, most: int = 4_000_000, least: int = 250_000) -> tuple[DataFrame, int]:
    """Scores under the whole model, whose pairs and words lie as packed arrays at as many places as there are shuffle partitions, each of ``least`` to ``most`` tokens."""
    slots = Slots(docs.sparkSession)
    chunks = slots.kept(chunk_lines(docs, chunk_tokens), "tokens")
    tokens = (_totals(chunks) or [0])[0]
    parts = int(max(1, tokens // most, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tokens // least)))
    words, chunks = numbered(chunks, parts, slots)
    tokens, known, ones, twos = _totals(_kind(words, "words")) or [0, 0, 0, 0]

    def frequent(batches):
        for batch in batches:
            for row in batch.to_pylist():
                count = _ints(row["arrays"][0])
                at = np.flatnonzero(count > max(1, tokens / parts))
                yield pa.RecordBatch.from_arrays([pa.array(at * parts + row["place"]), pa.array(count[at])], ["id", "n"])

    found = sorted(_kind(words, "words").mapInArrow(frequent, "id long, n long").collect())  # At most ``parts`` rows.
    hot, hot_counts = np.array([r["id"] for r in found], dtype=np.int64), np.array([r["n"] for r in found], dtype=np.int64)
    pairs = counted_pairs(chunks, parts, hot, hot_counts, slots)
    once, twice, *tables = _totals(_kind(pairs, "pairs")) or [0, 0]
    settings = Settings(int(known), (_discount({"a": ones, "b": twos}, "a", "b"), _discount({"a": once, "b": twice}, "a", "b")), np.zeros(0))
    state, index = pairs, _kind(pairs, "index")
    heads, hot_tables = words, []
    for sweep in range(burn_in + samples + 1):
        if sweep:
            state = slots.kept(_answered(_kind(state, "pairs"), _kind(heads, "answer"), _pair_sweep(settings, np.array(tables), sweep, sweep > burn_in)), f"seats-{sweep % 2}")
            tables = _totals(_kind(state, "pairs"))
            hot_tables += [tables] if sweep > burn_in else []
        heads = slots.kept(_answered(_kind(heads, "words"), _kind(state, "ask"), _word_sweep(settings, sweep, sweep > burn_in)), f"heads-{sweep % 2}")
        settings.sums.append(_totals(_kind(heads, "words")) or [0.0, 0.0])
    everywhere = np.array(hot_tables, dtype=np.float64).reshape(samples, len(hot))

    def of_pairs(left, right):
        s, out = PairState.read(left), []
        each = s.kept.reshape(samples, -1)
        by_context = np.array([s.tables(t, e) for t, e in zip(each, everywhere)]).reshape(samples, -1)
        total = each.sum(axis=0)
        for r in right:
            rows, runs = _ints(r["arrays"][1]), _ints(r["arrays"][2])
            out.append(_line("pairs", r["other"], left["place"], [r["arrays"][0], pack(total[rows]), pack(s.c[runs]), *[pack(t[runs]) for t in by_context]]))
        return out

    def of_words(left, right):
        count, kept = _ints(left["arrays"][0]), [_ints(k).reshape(samples, -1) for k in left["arrays"][5:7]]
        return [_line("words", r["other"], left["place"], [pack(x[at]) for x in (count, *kept[0], *kept[1])]) for r in right for at in [_ints(r["arrays"][0])]]

    ready = slots.kept(_answered(_kind(state, "pairs"), index, of_pairs), "seats-" + "10"[(burn_in + samples) % 2])
    known_words = slots.kept(_answered(_kind(heads, "words"), _back(_kind(words, "number")), of_words), "heads-" + "10"[(burn_in + samples) % 2])
    denominator = tokens + known + 1

    def of_chunk(left, right):
        own = ChunkPairs(left["arrays"], parts, hot)
        count, probs = np.zeros(len(own.ids), np.int64), np.zeros((samples, len(own.ids)))
        from_pairs, from_words = ([[_ints(a) for a in r["arrays"]] for r in right if r["kind"] == k] for k in ("pairs", "words"))
        for (_, at), got in zip(_split(own.ids % parts), from_words, strict=True):
            count[at] = got[0]
            for i in range(samples):
                probs[i, at] = settings.parent_probability(got[1 + i], got[1 + samples + i], settings.sums[burn_in + 1 + i])
        p = np.zeros(len(own.first))
        for (_, at), (n, total, c, *tables) in zip(_split(own.place), from_pairs, strict=True):
            t, start = n.astype(np.float64), own.runs(at)
            t[n > 1] = total / samples
            run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(at))))
            given = sum((((settings.s2 + settings.d2 * tables[i]) / (settings.s2 + c))[run] * probs[i, own.own[at]] for i in range(samples)), 0.0) / samples
            p[at] = (n - settings.d2 * t) / (settings.s2 + c)[run] + given
        score = np.empty(len(own.tokens))
        score[own.order] = np.repeat(np.log10(p), np.diff(np.append(own.first, len(own.order))))
        doc = np.repeat(np.arange(len(own.sizes)), own.sizes)
        of_word = [(count > 0).astype(np.float64), np.log10((count + 1) / denominator)]
        known_sum, base, total = (np.bincount(doc, w) for w in (*[x[own.tokens] for x in of_word], score))
        names, n = left["arrays"][3], len(own.sizes)
        ids = pa.array(np.frombuffer(names, "<i8", n), mask=np.frombuffer(names, np.uint8, n, 8 * n) == 0)
        return pa.table([ids, *[pa.array(x) for x in (own.sizes, known_sum.astype(np.int64), base, total)]], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = _answered(chunks, ready.unionByName(known_words), of_chunk, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out, int(tokens)


def document_scores(partial: DataFrame) -> DataFrame:
    """A row for each document; a group is one chunk's documents."""
    def of(group: pa.Table) -> pa.Table:
        names = next(x for x in group.column("names").to_pylist() if x is not None)
        n = len(names) // 9
        sums = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)]
        parts = [c.to_pylist() for c in group.select(["doc", "tokens", "known", "base", "score"]).columns]
        for doc, *values in zip(*parts):
            if doc is not None:
                at = np.frombuffer(doc, "<u4")
                for total, value, kind in zip(sums, values, ("<u4", "<u4", "<f8", "<f8")):
                    total[at] += np.frombuffer(value, kind).astype(total.dtype)
        ids = pa.array(np.frombuffer(names, "<i8", n), mask=np.frombuffer(names, np.uint8, n, 8 * n) == 0)
        return pa.table([ids, *[pa.array(s) for s in sums]], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return partial.groupBy("chunk").applyInArrow(of, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def scored(docs: DataFrame, contexts: int | None = None, burn_in: int = 2, samples: int = 3, chunk_tokens: int = 3_000_000) -> tuple[DataFrame, int]:
    """Scores of ``docs`` (doc_id, text, learned) under the model of the rows with ``learned``, and how many tokens those have.

    Every context has a restaurant, unless ``contexts`` says how many of the most frequent ones have.
    """
    if contexts is not None and not 0 < contexts < 65_535:
        raise ValueError("contexts are numbered in two bytes")
    small_batches(docs.sparkSession, 8192)
    if contexts is None:
        return packed_scores(docs, burn_in, samples, chunk_tokens)
    rows, settings, numbers, totals = learned_model(docs, contexts, burn_in, samples, chunk_tokens)
    model = predictive(rows, settings, burn_in)
    matched = occurrences(docs, numbers, chunk_tokens).join(model, "word", "left").select("chunk", "ctx", "doc", "names", "n", "top", "ctxs", "probs")
    return document_scores(partial_scores(matched, settings, burn_in, totals)), totals["tokens"]


def language_model_query(docs: DataFrame) -> DataFrame:
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7, F.lit(0))
    slim = docs.select(col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), (remainder != 2).alias("learned"))
    out, tokens = scored(slim)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
