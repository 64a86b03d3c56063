"""How each source's words differ from those of every other source of its language.

Terms are dictionary-encoded to integers: kept terms lie in sorted arrays, chunk by chunk, ids come
from searchsorted, counts of a group from bincount. Ids keep the order of UTF-8, so that a chunk's
counts are dense vectors, one for each group, and ties are broken by id.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialise, tidy

SCALE = 1_000_000_000
#: A-Z to a-z; letters and bytes of other characters stay, all else parts terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
#: Cells of a dense matrix, and rows of groups that are broadcast.
_CELLS, _GROUPS = 1 << 20, 1_000_000


def terms_of(text: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, a list for each piece of about ``piece`` bytes; no term is cut."""
    if len(text) <= piece:
        yield text.translate(_FOLD).split()
        return
    start = 0
    while start < len(text):
        end = start + piece
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        yield text[start:end].translate(_FOLD).split()
        start = end


def count_terms(docs: DataFrame, max_entries: int = 300_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed in each task as far as
    ``max_entries`` entries allow; the same key may come in several rows."""
    bound_batches(docs.sparkSession)

    def run(batches):
        n, in_docs = defaultdict(Counter), defaultdict(Counter)

        def drain():
            for (lang, source), c in n.items():
                d = in_docs[lang, source]
                k = len(c)
                yield pa.record_batch([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()),
                                       pa.array(list(c.values()), pa.int64()), pa.array([d[t] for t in c], pa.int64())], schema=_COUNTS)
            n.clear()
            in_docs.clear()

        held = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                text = text.as_py()
                if not text:
                    continue
                counts, seen = n[lang, source], set()
                before = len(counts)
                for terms in terms_of(text):
                    counts.update(terms)
                    seen.update(terms)
                in_docs[lang, source].update(seen)
                held += len(counts) - before
                if held >= max_entries:
                    yield from drain()
                    held = 0
        yield from drain()

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], "text")
    return named.mapInArrow(tidy(run), "lang string, source string, term string, n long, docs long")


def kept_counts(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n) of terms in at least ``min_docs`` documents of their language. One
    shuffle by (lang, term): a term's rows are its task sums, so few even where the term is common."""
    dealt = counts.repartition("lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return summed.withColumn("df", whole).filter(F.col("df") >= min_docs).select("lang", "source", "term", "n")


def share(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + terms)), exact for counts of any size."""
    if counts.size and int(counts.max()) >= (1 << 63) // SCALE - 1 or total + terms >= 1 << 63:
        return np.array([1 + SCALE * (int(c) + 1) // (total + terms) for c in counts.ravel()], np.int64).reshape(counts.shape)
    return np.asarray(1 + SCALE * (counts + 1) // (total + terms), np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); p and q are at most 10^9 + 1, so 64 bits hold all of it."""
    d = p - q
    return d * d // q


def _chunk(ids: np.ndarray, groups: np.ndarray, n: np.ndarray, terms: int, totals: np.ndarray, v: int, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts (groups x terms), their shares, and the language's shares of a chunk."""
    flat = groups * terms + ids
    exact = int(n.sum()) < 1 << 53  # bincount sums in double
    if exact:
        counts = np.bincount(flat, n, n_groups * terms).astype(np.int64)
    else:
        counts = np.zeros(n_groups * terms, np.int64)
        np.add.at(counts, flat, n)
    counts = counts.reshape(n_groups, terms)
    p = np.stack([share(c, int(t), v) for c, t in zip(counts, totals)])
    whole = np.array([sum(map(int, c)) for c in counts.T], object) if not exact else counts.sum(0)
    q = share(np.asarray(whole), int(sum(map(int, totals))), v)
    return counts, p, q


def _compare(kept: DataFrame, groups: dict[str, tuple[list[str], list[int], int]], top: int) -> DataFrame:
    """Sums of pairs and the ``top`` terms of each group, for the chunks of each task. ``kept`` is
    dealt in ranges of (lang, term) and sorted by them."""
    held = kept.sparkSession.sparkContext.broadcast(groups)

    def run(batches):
        pairs: dict[str, np.ndarray] = {}
        best: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}

        def take(lang, block):
            names, totals, v = held.value[lang]
            number = {s: i for i, s in enumerate(names)}
            terms = _bytes(block.column("term"))
            change = np.ones(len(terms), bool)
            change[1:] = terms[1:] != terms[:-1]
            sorted_terms = terms[change]
            group = np.array([number[s] for s in block.column("source").to_pylist()], np.int64)
            n = block.column("n").to_numpy()
            width = max(1, _CELLS // len(names))
            for a in range(0, len(sorted_terms), width):
                chunk = sorted_terms[a : a + width]
                lo = np.searchsorted(terms, chunk[0])
                hi = len(terms) if a + width >= len(sorted_terms) else np.searchsorted(terms, sorted_terms[a + width])
                ids = np.searchsorted(chunk, terms[lo:hi])
                counts, p, q = _chunk(ids, group[lo:hi], n[lo:hi], len(chunk), totals, v, len(names))
                sums = pairs.setdefault(lang, np.zeros((len(names), len(names)), np.int64))
                for g in range(len(names)):
                    sums[g] += divergence(p[g][None, :], p).sum(1)
                    at = np.flatnonzero((counts[g] > 0) & (p[g] > q))
                    if len(at):
                        value, item = divergence(p[g][at], q[at]), chunk[at]
                        if (lang, g) in best:  # ids ascend from chunk to chunk, so a stable sort breaks ties by id
                            value, item = np.append(best[lang, g][0], value), np.append(best[lang, g][1], item.astype(object))
                        order = np.argsort(-value, kind="stable")[:top]
                        best[lang, g] = value[order], item[order]

        def drain():
            for lang, sums in pairs.items():
                names = held.value[lang][0]
                for g, s in enumerate(names):
                    other = [i for i in range(len(names)) if i != g]
                    yield _rows(lang, s, "pair", [names[i] for i in other], sums[g][other])
            for (lang, g), (value, item) in best.items():
                yield _rows(lang, held.value[lang][0][g], "term", [t.decode() for t in item], value)

        carry = None
        for batch in batches:
            if carry is not None:
                batch = pa.concat_tables([pa.table(carry), pa.table(batch)]).combine_chunks().to_batches(max_chunksize=None)[0]
                carry = None
            lang_col, term_col = batch.column("lang"), batch.column("term")
            last = pc.and_(pc.equal(lang_col, lang_col[-1]), pc.equal(term_col, term_col[-1])).to_numpy(zero_copy_only=False)
            cut = int(np.argmax(last))  # the last term may go on in the next batch
            carry = batch.slice(cut)
            _by_language(batch.slice(0, cut), take)
        if carry is not None:
            _by_language(carry, take)
        yield from drain()

    return kept.mapInArrow(tidy(run), "lang string, source string, part string, item string, value long")


def _bytes(terms: pa.Array) -> np.ndarray:
    """UTF-8 of terms, in fixed width where none is long; bytes sort as code points do."""
    data = terms.cast(pa.binary())
    width = pc.max(pc.binary_length(data)).as_py() or 1
    return np.array(data.to_pylist(), f"S{width}" if width <= 64 else object)


def _by_language(batch, take) -> None:
    """Hand each language's rows of a sorted batch to ``take``."""
    if batch.num_rows:
        langs = batch.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        edges = (np.flatnonzero(np.diff(codes)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, len(codes)]):
            take(langs.dictionary[int(codes[a])].as_py(), batch.slice(a, b - a))


def _rows(lang: str, source: str, part: str, items: list[str], values: np.ndarray):
    k = len(items)
    return pa.record_batch([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array([part] * k, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], schema=_FOUND)


def audit_sources(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) of ``docs``: part ``pair``
    compares it with each other source of its language over all kept terms, part ``term`` gives the
    ``top`` terms it has more of than the language.

    Null text, lang and source are read as the empty string; empty and null texts have no terms
    but their group is there, with the shares that counts of 0 give. A language without kept terms
    has pairs of value 0 and no terms. Repeated rows count once each. An empty table gives no
    rows. Columns other than text, lang and source are ignored. The result has a row for each pair
    of sources; beyond 1,000,000 groups, whose totals tasks could not hold, it is refused.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    groups = materialise(named.distinct(), "groups")
    counted = kept_counts(count_terms(docs), min_docs)
    kept = materialise(counted, "kept-terms")
    totals = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").limit(_GROUPS + 1).collect()
    if len(totals) > _GROUPS:
        raise ValueError(f"more than {_GROUPS} groups of language and source")
    sizes = {r["lang"]: r["v"] for r in kept.groupBy("lang").agg(F.count_distinct("term").alias("v")).collect()}
    by_lang: dict[str, list] = defaultdict(list)
    for r in totals:
        by_lang[r["lang"]].append((r["source"], r["n"] or 0))
    held = {lang: ([s for s, _ in sorted(x)], [n for _, n in sorted(x)], sizes[lang]) for lang, x in by_lang.items() if lang in sizes}
    found = _compare(kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term"), held, top)
    other = groups.select("lang", F.col("source").alias("item"))
    zeros = groups.join(other, "lang").filter(F.col("source") != F.col("item")).select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    summed = found.unionByName(zeros).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))
