"""Personal data: four patterns, and terms that reveal what they found.

The protected entities are the distinct values of the patterns. Terms are words of letters, three or more, in
lower case, outside of matches. Over all distinct documents (doc_id and text), p(e|t) is the share of the documents with term t that have
entity e too, anywhere, and log2(p(e|t) / p(e)) is what the term tells of the entity. A pair is disclosed if
it has the support of SUPPORT unlike contexts at least, p(e|t) >= SHARE and the term tells BITS or more. A context is
the NEAR whole terms, however long and far, on each side of the entity (the whole text, where there are none): copies of a passage are one. A
document supports a pair by the context of its first match of the entity, and by each that has the term.
All occurrences of a disclosed term, in whole texts and in documents without a match too, are generalised, from SHARE_REMOVED on removed.

Entities with fewer contexts than SUPPORT disclose nothing, so terms are gathered from the documents of the others only. Bit
tables of fixed size keep tasks from reporting entities and words that can't matter; what follows them is exact.

Nulls and empty texts have no spans. Rows that repeat doc_id and text are one document in all counts and have the same result each; unlike texts
with one doc_id are documents of their own. Ties: spans by start, kind, end. Very long texts take time in proportion to their length. Other columns, whatever
their names, aren't read (sanitise passes them on). Empty table: an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import bit_table, fresh, rows_of, stash

#: The kinds in their order; the last two are the method's: generalised and removed terms.
KINDS = ("email", "ip", "card", "phone", "term", "removed")
NEAR = 6
SUPPORT = 3
SHARE = 0.5
SHARE_REMOVED = 0.9
BITS = 3.0
TABLE_BITS = 1 << 24
#: Documents, drawn by their hash, in which terms are counted first. What stands there too often already can't reveal anything; the rest is counted in all.
FIRST_DOCS = 20_000
COUNTED_WORDS = 200_000
BATCH_BYTES = 4 << 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can't begin within a run of digits: it would have begun at the run's first one.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left over what a name may have, but not into the match before, and to the right."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) by start, then kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash(x: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(x, 42) - (1 << 63)


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, stop) of each term outside of the spans."""
    inside, k, end = sorted((a, b) for a, _, b in spans), 0, -1
    for m in TERM.finditer(text):
        while k < len(inside) and inside[k][0] < m.end():
            end, k = max(end, inside[k][1]), k + 1
        if end <= m.start():
            yield m[0].lower(), m.start(), m.end()


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, set[str]]]:
    """Of each match: its entity and context, hashed, and the terms of the context."""
    if not spans:
        return []
    terms = list(terms_of(text, spans))
    starts, out = [a for _, a, _ in terms], []
    for a, k, b in spans:
        value = text[a:b].lower() if k < 2 else NOT_DIGIT.sub("", text[a:b])
        to, since = bisect_left(starts, a), bisect_left(starts, b)
        words = [w for w, _, _ in (*terms[max(0, to - NEAR) : to], *terms[since : since + NEAR])]
        out.append((_hash(f"{k}:{value}"), _hash(" ".join(words) or text), set(words)))
    return out


FOUND = "doc_id long, tie long, base array<struct<start:int,kind:int,stop:int>>, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, entities array<struct<entity:long,context:long>>"


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches, BATCH_BYTES):
        base, counts, sha, entities = [], [], [], []
        for text in batch.column(2):
            text = text.as_py() or ""
            spans = base_spans(text)
            base.append([{"start": a, "kind": k, "stop": b} for a, k, b in spans])
            counts.append([sum(k == n for _, k, _ in spans) for n in range(4)])
            sha.append(hashlib.sha256(joined(spans).encode()).hexdigest())
            entities.append([{"entity": e, "context": c} for e, c, _ in contexts(text, spans)])
        i32, i64 = pa.int32(), pa.int64()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(base, pa.list_(pa.struct([("start", i32), ("kind", i32), ("stop", i32)]))),
                *(pa.array(c, i64) for c in zip(*counts, strict=True)),
                pa.array(sha),
                pa.array(entities, pa.list_(pa.struct([("entity", i64), ("context", i64)]))),
            ],
            ["doc_id", "tie", "base", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "entities"],
        )


def find(docs: DataFrame) -> DataFrame:
    """Of each row: its base spans, their entities and contexts; in the shared folder. tie: XXH64 of the text."""
    return stash(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text").mapInArrow(_find, FOUND))


def _has(table: np.ndarray, h: int) -> bool:
    at = h & (64 * len(table) - 1)
    return bool(table[at >> 6] >> np.uint64(at & 63) & np.uint64(1))


def _may(table: np.ndarray):
    """Whether the bit table may have a word."""
    import xxhash

    known: dict[str, bool] = {}

    def may(word: str) -> bool:
        if (x := known.get(word)) is None:
            if len(known) > 300_000:
                known.clear()
            x = known[word] = _has(table, xxhash.xxh64_intdigest(word, 42))
        return x

    return may


def _together(table: np.ndarray):
    """Over rows (doc, text): (entity, term, context, doc, first) of the entities that the bit table has and all terms of their documents; of a
    document and a term one row is first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["entity", "term", "context", "doc", "first"])

        for batch in rows_of(batches, BATCH_BYTES):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                spans = base_spans(text)
                of: dict[int, list] = {}
                for e, c, near in contexts(text, spans):
                    if _has(table, e):
                        of.setdefault(e, []).append((c, near))
                if not of:
                    continue
                terms = {w for w, _, _ in terms_of(text, spans)}
                for k, (e, found) in enumerate(of.items()):
                    rows += [(e, w, found[0][0], doc, int(k == 0)) for w in terms]
                    rows += {(e, w, c, doc, 0) for c, near in found[1:] for w in near & terms}
                    if len(rows) > 200_000:
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)

    return run


def _count(table: np.ndarray):
    """Over rows (doc, text), of each task (or each COUNTED_WORDS words of it): words that the bit table has, and in how many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, counts = _may(table), {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        for batch in rows_of(batches, BATCH_BYTES):
            for text in batch.column(1):
                for word in filter(may, {w.lower() for w in TERM.findall(text.as_py())}):
                    counts[word] = counts.get(word, 0) + 1
            if len(counts) > COUNTED_WORDS:
                yield out()
                counts = {}
        if counts:
            yield out()

    return run


def told(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(term, entity, together, total, of_entity, n) of the pairs with support (all that can be disclosed), counts over distinct documents."""
    name = F.xxhash64("doc_id", "tie").alias("doc")
    known = found.select(name, F.explode("entities").alias("x")).select("doc", "x.entity", "x.context")
    entities = known.groupBy("entity").agg(F.count_distinct("doc").alias("of_entity"), F.count_distinct("context").alias("contexts"))
    entities = stash(entities.where(F.col("contexts") >= SUPPORT).drop("contexts"))
    repeated = stash(found.groupBy(name).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    n = found.count() - (repeated.agg(F.sum(F.col("rows") - 1)).first()[0] or 0)
    once = docs.where("text is not null").select(F.xxhash64("doc_id", F.xxhash64("text")).alias("doc"), "text")
    if not repeated.isEmpty():  # of repeated rows one
        once = once.join(repeated, "doc", "left_anti").union(once.join(repeated, "doc", "left_semi").dropDuplicates(["doc"]))
    near = once.mapInArrow(_together(bit_table(entities, F.col("entity"), TABLE_BITS)), "entity long, term string, context long, doc long, first long")
    pairs = near.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("doc").alias("together"), F.sum("first").alias("first"))
    # the entities' documents alone that have a term bound its share from above: common words needn't be counted in all documents
    seen = pairs.groupBy("term").agg(F.sum("first").alias("seen"))
    most = F.col("together") / F.col("seen")
    likely = pairs.where(F.col("contexts") >= SUPPORT).join(seen, "term").join(entities, "entity").where((most >= SHARE) & (F.log2(most * n / F.col("of_entity")) >= BITS))
    pairs = stash(likely.select("entity", "term", "together", "of_entity"))

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.mapInArrow(_count(bit_table(pairs, F.xxhash64("term"), TABLE_BITS)), "term string, n long").groupBy("term").agg(F.sum("n").alias(name))

    # so do some documents, which are few: a count there is one from below
    first = once.where(F.pmod("doc", F.lit(max(1, n // FIRST_DOCS))) == 0).repartition(4)
    most = F.col("together") / F.greatest("together", F.coalesce("least", F.lit(0)))
    pairs = stash(pairs.join(counted(first, "least"), "term", "left").where((most >= SHARE) & (F.log2(most * n / F.col("of_entity")) >= BITS)).drop("least"), [pairs])
    totals = counted(once, "total")
    return pairs.join(totals, "term").select("term", "entity", "together", "total", "of_entity", F.lit(n).alias("n"))


def disclosed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(term, kind) of the terms that reveal an entity, by the whole corpus."""
    share = F.col("together") / F.col("total")
    over = told(docs, found).withColumn("share", share).where((share >= SHARE) & (F.log2(share * F.col("n") / F.col("of_entity")) >= BITS))
    return stash(over.groupBy("term").agg(F.when(F.max("share") >= SHARE_REMOVED, 5).otherwise(4).alias("kind")))


def _places(table: np.ndarray):
    """Over rows (doc_id, tie, text): where words stand that the bit table has, outside of matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = _may(table)
        for batch in rows_of(batches, BATCH_BYTES):
            rows = []
            for k, text in enumerate(batch.column(2)):
                text = text.as_py()
                if hit := set(filter(may, {w.lower() for w in TERM.findall(text)})):
                    rows += [(k, *x) for x in terms_of(text, base_spans(text)) if x[0] in hit]
            if rows:
                at, *columns = zip(*rows, strict=True)
                own = batch.select([0, 1]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()), strict=True))], ["doc_id", "tie", "term", "start", "stop"])

    return run


def term_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, tie, terms: array of (start, kind, stop)) of the documents that have any."""
    terms = disclosed(docs, found)
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("tie"), "text")
    places = rows.mapInArrow(_places(bit_table(terms, F.xxhash64("term"), TABLE_BITS)), "doc_id long, tie long, term string, start int, stop int")
    return places.join(terms, "term").groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "stop"))).alias("terms"))


def _named(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ",")


def op8(docs: DataFrame) -> DataFrame:
    """The contract's columns, and n_spans: all spans, the method's too."""
    found = find(docs)
    terms = stash(term_spans(docs, found))
    rows = found.drop("entities")
    same = rows.doc_id.eqNullSafe(terms.doc_id) & (rows.tie == terms.tie)
    every = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.concat("base", "terms"))
    return rows.join(terms, same, "left").select(rows.doc_id, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", _named(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))


#: What stands for a span of each kind.
GENERAL = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<TERM>", "")
BROADCAST_ROWS = 50_000


def cleaned(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span's general name instead; of spans that overlap the first one's, and all of them go."""
    parts, end = [], 0
    for a, k, b in sorted(spans):
        if a >= end:
            parts += [text[end:a], GENERAL[k]]
        end = max(end, b)
    return "".join([*parts, text[end:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data and disclosing terms generalised or removed in text; n_chars, where there is one, counted anew."""
    terms = stash(term_spans(docs, find(docs)))
    few = terms.count() <= BROADCAST_ROWS  # some hundred bytes each
    own, tie, found = fresh(docs, "__id", "__tie", "__terms")
    terms = terms.select(F.col("doc_id").alias(own), F.col("tie").alias(tie), F.col("terms").alias(found))
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(tie))
    both = docs.join(F.broadcast(terms) if few else terms, same, "left").drop(own, tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, BATCH_BYTES):
            names = batch.schema.names[:-1]
            columns = list(batch.columns[:-1])
            at = names.index("text")
            texts, made, changed = columns[at].to_pylist(), [], []
            for text, terms in zip(texts, batch.column(len(names)).to_pylist(), strict=True):
                spans = base_spans(text) if text else []
                spans += [(x["start"], x["kind"], x["stop"]) for x in terms or ()]
                made.append(cleaned(text, spans) if spans else text)
                changed.append(bool(spans))
            if any(changed):
                columns[at] = pa.array(made, columns[at].type)
                if "n_chars" in names:
                    c = names.index("n_chars")
                    columns[c] = pa.array([len(t) if x else n for t, x, n in zip(made, changed, columns[c].to_pylist(), strict=True)], columns[c].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return both.select(*docs.columns, found).mapInArrow(run, docs.schema)
