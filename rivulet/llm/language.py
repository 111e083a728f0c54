"""Language identification by prediction by partial matching (PPM).

Every language has a tree of byte contexts of order 0 to 3 with the counts of
the bytes that follow.  A byte costs -log2 of its share in the longest known
context, or the price of an escape (method C: distinct/(total + distinct)) and
its cost one order lower, down to 8 bits at order -1.  Statistics are frozen
after fitting, so the cost of a text is exact and independent of its place.
The language whose tree codes the text shortest wins.

The trees hold every context of the sample and nothing else: per order a sorted
list of contexts and of (context, byte) pairs, each with the languages that
have it.  Their size is that of the sample's distinct contexts, whatever the
number of languages or byte values.  The distinct four-byte strings of a run of
texts are looked up once, from the lowest order up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import batches_of, held_out, table, text_of

ORDER = 3
# bound of the fit: about so many rows of each language, none longer than this
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 65536
SEED = 7
UNKNOWN = "und"
RUN_BYTES = 1 << 20
# prices held at a time, over strings and languages
CELLS = 1 << 22
# prices are whole multiples of this, so that sums of them don't depend on their order
UNIT = 2.0 ** -20
_PAD = b"   "  # every text is coded as if three spaces stood before it


def prepared(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _grams(raw: bytes) -> np.ndarray:
    """Each byte with the three before it, as one number."""
    b = np.frombuffer(_PAD + raw, dtype=np.uint8).astype(np.int64)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


@dataclass
class Lists:
    """Numbers of (language, value) by key: ``keys`` sorted, those of key i from ``at[i]`` to ``at[i + 1]``."""
    keys: np.ndarray
    at: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, lang: np.ndarray, value: np.ndarray) -> "Lists":
        order = np.lexsort((lang, key))
        keys, first = np.unique(key[order], return_index=True)
        return cls(keys.astype(np.uint32), np.append(first, len(key)), lang[order].astype(np.int32), value[order].astype(np.float32))

    def find(self, wanted: np.ndarray):
        """Rows of ``wanted``, languages and values of all that is listed under them."""
        i = np.minimum(np.searchsorted(self.keys, wanted), max(0, len(self.keys) - 1))
        rows = np.flatnonzero(self.keys[i] == wanted) if len(self.keys) else np.zeros(0, np.int64)
        i = i[rows]
        n = self.at[i + 1] - self.at[i]
        item = np.arange(n.sum()) + np.repeat(self.at[i] - np.append(0, np.cumsum(n)[:-1]), n) if len(rows) else np.zeros(0, np.int64)
        return np.repeat(rows, n), self.lang[item], self.value[item]


@dataclass
class Model:
    langs: list[str]
    escapes: list[Lists]  # by order: context -> bits of an escape
    bytes: list[Lists]    # by order: context and byte -> bits, with the escapes before it

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each four-byte string under each language."""
        out = np.full((len(grams), len(self.langs)), 8.0)
        for order, (escapes, known) in enumerate(zip(self.escapes, self.bytes)):
            wanted = (grams & ((1 << 8 * (order + 1)) - 1)).astype(np.uint32)
            rows, lang, bits = escapes.find(wanted >> 8)
            out[rows, lang] += bits
            rows, lang, bits = known.find(wanted)
            out[rows, lang] = bits
        return np.rint(out / UNIT) * UNIT

    def code_lengths(self, raws: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(raws), len(self.langs)))
        step = max(1, CELLS // len(self.langs))
        for at, run in _runs(raws):
            stream = np.concatenate([_grams(r) for r in run])
            text = np.repeat(np.arange(at, at + len(run)), [len(r) for r in run])
            for k in range(0, len(stream), step):
                grams, inverse = np.unique(stream[k:k + step], return_inverse=True)
                cost, mine = self.costs(grams), text[k:k + step] - at
                for lang in range(len(self.langs)):
                    out[at:at + len(run), lang] += np.bincount(mine, weights=cost[inverse, lang], minlength=len(run))
        return out


def _runs(raws: list[bytes]):
    at = 0
    for (run,) in batches_of([raws], RUN_BYTES):
        yield at, run
        at += len(run)


def build(langs: list[str], lang: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> Model:
    """Trees from the counts of four-byte strings; ``lang`` is the place of each string's language in ``langs``."""
    lang = lang.astype(np.int64)
    escapes, known = [], []
    for order in range(ORDER + 1):
        # a context and a byte of one language as one number, languages apart
        both, back = np.unique((lang << 32) | (grams & ((1 << 8 * (order + 1)) - 1)), return_inverse=True)
        n = np.bincount(back, weights=counts, minlength=len(both))
        context, which = np.unique((both >> 32 << 32) | ((both & 0xFFFFFFFF) >> 8), return_inverse=True)
        distinct = np.bincount(which, minlength=len(context))
        bottom = np.bincount(which, weights=n, minlength=len(context)) + distinct
        escapes.append(Lists.of(context & 0xFFFFFFFF, context >> 32, np.log2(bottom / distinct)))
        known.append(Lists.of(both & 0xFFFFFFFF, both >> 32, np.log2(bottom[which] / n)))
    return Model(langs, escapes, known)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, seed: int = SEED) -> Model | None:
    """Trees from a bounded sample of the rows with a language that are not held out.

    The sample takes the same share of a language's rows everywhere (by a
    seeded hash of the id), about ``sample_rows`` of each, none above
    ``sample_bytes``.  None if no row has a language.
    """
    marked = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"), F.col(lang_col).alias("_l")) \
        .where(F.col("_l").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    sizes = marked.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["_l"], min(1.0, sample_rows / r["n"]))])
    unit = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = marked.where((unit < share[F.col("_l")]) & (F.octet_length("_t") <= sample_bytes))

    def count(batches):
        import pyarrow as pa
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for t, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(prepared(t.as_py()))
            for lang, raws in by_lang.items():
                for (run,) in batches_of([raws], RUN_BYTES):
                    gram, n = np.unique(np.concatenate([_grams(r) for r in run]), return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], names=["l", "g", "n"])

    # its size is bounded by the sample's
    found = sample.select("_t", "_l").mapInArrow(count, "l string, g long, n long") \
        .groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return None
    named = found["l"].combine_chunks().dictionary_encode()
    names = named.dictionary.to_pylist()
    langs = sorted(names)
    place = np.array([langs.index(x) for x in names])
    return build(langs, place[named.indices.to_numpy()], found["g"].to_numpy(), found["n"].to_numpy().astype(np.float64))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             **fitting) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``lang_pred``, ``score``.

    ``score`` is the winner's share when the languages' code lengths are taken
    as likelihoods; of equal lengths the first language by name wins.  A text
    that is null or has no letter is ``und`` with score 0, and so is every
    text when no row has a language.  Repeated rows get equal results.  A text
    of any length is coded whole, from its first byte to its last.  Other
    columns of ``docs`` are not read.  An empty table gives an empty result.
    """
    model = fit(docs, id_col, text_col, lang_col, **fitting)
    # plain arrays, bounded by the sample; workers need no installed copy of the classes
    plain = model and (model.langs, [vars(x) for x in model.escapes], [vars(x) for x in model.bytes])
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    def run(batches):
        import pyarrow as pa
        model = None
        if shared.value:
            langs, escapes, known = shared.value
            model = Model(langs, [Lists(**x) for x in escapes], [Lists(**x) for x in known])
        for batch in batches:
            pred, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            at, raws = [], []

            def flush():
                bits = model.code_lengths(raws)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                for i, b, s in zip(at, best, share):
                    pred[i], score[i] = model.langs[b], s
                at.clear()
                raws.clear()

            size = 0
            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                if model and has_letter(text):
                    at.append(i)
                    raws.append(prepared(text))
                    size += len(raws[-1])
                    if size > RUN_BYTES:
                        flush()
                        size = 0
            if raws:
                flush()
            yield pa.record_batch([batch.column(0), pa.array(pred), pa.array(score)], names=["_id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_t")) \
        .mapInArrow(run, "_id bigint, lang_pred string, score double")
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "lang_pred", "score")


def op7_language(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
