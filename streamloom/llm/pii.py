"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give them away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. An entity is one such value. Around each
mention the words within WINDOW words are its context; contexts of equal content (copies) are one piece of evidence. Over
the whole corpus, a term's disclosure of an entity is the pointwise mutual information, in bits, between "an occurrence of
the term" and "standing in a context of the entity": log2( share / P(entity) ), with the share of the term's occurrences
that stand in contexts of the entity. P(entity | term) is this share smoothed by PSEUDO occurrences that follow P(entity),
where the others weigh as much as there are different contexts: so a word that stands once in the corpus, or only in
copies of one context, discloses nothing. A term is disclosing if P(entity | term) >= MIN_POSTERIOR, the
information reaches MIN_BITS, and chance is ruled out: by Chernoff's bound, so large a share of the occurrences stands
with the entity by chance with probability at most 2^-(occurrences * divergence of the two shares), and this must be below
2^-MIN_BITS divided by the number of pairs of term and entity that were tried. All occurrences of a disclosing term are
spans of kind "term": redacting generalises them to the class of what they disclose, as in [EMAIL TERM].

Counts cover all documents. Terms are counted in two scans: the first finds contexts, and how often their terms occur
in the documents that have them, which is a bound on all occurrences and rules out common words, behind a bit table
before pairs are joined by term; the second counts the terms that are left everywhere, behind a bit table of fixed size
that only saves shuffling; the join that follows is exact. Up to TERM_BLOCK disclosing terms are broadcast to the last scan. More of them meet the texts in a join: words
that pass the bit table go to the terms by their hash and come back by the MD5 of their text.

Base patterns are matched in time linear in the text: an address is looked for around each "@", and a run of digits and
dots is cut up once.

Defined cases: null text has no spans and stays null when redacted; repeated rows are each handled; offsets are code
points; equal starts are ordered as the kinds are listed, terms last; other columns pass through.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Fixed patterns of the base detectors.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
WINDOW = 6
MIN_POSTERIOR = 0.5
MIN_BITS = 6.0
PSEUDO = 2.0
TERM_BLOCK = 200_000
#: Bits of the table that spares shuffling words that are no candidates.
TABLE_BITS = 22
_DIGIT = re.compile("[0-9]")
_CARD, _PHONE = re.compile(CARD), re.compile(PHONE)
#: What may stand before the "@" of EMAIL, what must follow it, and a whole run of what IP is made of.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_WORD = re.compile(r"[^\W\d_]{3,}")
_WORDS = re.compile(r"\S+")


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of EMAIL."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        # From the end of the last match or "@" on; the pieces looked at never overlap.
        start = free + len(text[free:at].rstrip(_LOCAL))
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, free)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", free)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """The matches of IP whose parts are at most 255: each run of dotted numbers is cut into fours."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base detectors, by start, then kind."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(a, b, 0) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(a, b, 1) for a, b in addresses(text)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2], s[1]))
    return [(a, b, KINDS[k]) for a, b, k in out]


def value_of(kind: str, found: str) -> str:
    return f"{kind}:{found.lower() if kind == 'email' else found if kind == 'ip' else re.sub('[^0-9]', '', found)}"


def term_hash(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little") >> (64 - TABLE_BITS)


def contexts(text: str) -> list[tuple[str, str, str, int, int]]:
    """(term, entity, content of the context, occurrences, occurrences in the text) for each mention.

    An occurrence counts once for an entity, also near two mentions; those in the text stand in one row of each term.
    """
    spans = base_spans(text)
    if not spans:
        return []
    mails = Taken((a, b) for a, b, kind in spans if kind == "email")
    words = [m.span() for m in _WORDS.finditer(text)]
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    out, had = [], set()
    for a, b, kind in spans:
        # The words that begin before the mention and that end after it, whole but for what touches the mention.
        i, j = bisect.bisect_left(starts, a), bisect.bisect_right(ends, b)
        left = [(x, min(y, a)) for x, y in words[max(0, i - WINDOW) : i]]
        right = [(max(x, b), y) for x, y in words[j : j + WINDOW]]
        near = " ".join(text[x:y] for x, y in left) + " | " + " ".join(text[x:y] for x, y in right)
        mark = hashlib.blake2b(near.encode(), digest_size=8).hexdigest()
        entity = value_of(kind, text[a:b])
        found: dict[str, int] = {}
        for word in left + right:
            for m in _WORD.finditer(text, *word):
                if mails(m.start(), m.end()):
                    continue
                term = m[0].lower()
                found[term] = found.get(term, 0) + ((entity, m.start()) not in had)
                had.add((entity, m.start()))
        out += [(t, entity, mark, n) for t, n in found.items()]
    times = Counter(_WORD.findall(text.lower()))
    return [(*row, times.pop(row[0], 0)) for row in out]


def term_table(spark: SparkSession, terms: DataFrame):
    """A broadcast table of 2^TABLE_BITS bits with the hashes of terms, whatever their number."""

    def bits(batches):
        table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                h = term_hash(t)
                table[h >> 3] |= 1 << (h & 7)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["bits"])

    # One row of fixed size from each task; OR over at most 64 tasks, one row at the driver at a time.
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for r in terms.coalesce(64).mapInArrow(bits, "bits binary").toLocalIterator():
        table |= np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(table.tobytes() if table.any() else b"")


def in_table(rows: DataFrame, shared) -> DataFrame:
    """Rows whose term is in a table of term_table, or shares a hash with one that is."""

    def run(batches):
        table = shared.value
        for batch in batches:
            hashes = [term_hash(t) for t in batch.column("term").to_pylist()] if table else []
            on = [bool(table[h >> 3] >> (h & 7) & 1) for h in hashes] if table else [False] * batch.num_rows
            yield batch.filter(pa.array(on, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def find_disclosing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """term, kind of its entity, posterior, bits: the disclosing terms of the corpus."""

    def scan(batches):
        for batch in batches:
            rows = [c for t in batch.column(0) if t.is_valid for c in contexts(t.as_py())]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), *(pa.array(c, pa.int64()) for c in cols[3:])], ["term", "entity", "mark", "n", "own"])

    seen = materialise(spark, docs.select("text").mapInArrow(scan, "term string, entity string, mark string, n long, own long"), "pii-contexts")
    mentions = seen.groupBy("entity").agg(F.countDistinct("mark").alias("n_entity"))
    pairs = materialise(spark, seen.groupBy("term", "entity").agg(F.sum("n").alias("together"), F.sum("own").alias("own"), F.countDistinct(F.when(F.col("n") > 0, F.col("mark"))).alias("support")), "pii-all-pairs")
    tried = max(1, pairs.count())
    # A pair of too few contexts cannot reach the posterior, with an entity rare enough for MIN_BITS ...
    pairs_left = pairs.filter(F.col("support") + PSEUDO * 2.0**-MIN_BITS >= MIN_POSTERIOR * (F.col("support") + PSEUDO))
    # ... nor one of a term that its own documents have too often elsewhere.
    able = pairs.groupBy("term").agg(F.max("together").alias("most"), F.sum("own").alias("least")).filter(F.col("most") >= MIN_POSTERIOR * F.col("least")).select("term", "least")
    able = materialise(spark, able, "pii-able")
    pairs_left = in_table(pairs_left.drop("own"), term_table(spark, able.select("term")))
    pairs = materialise(spark, pairs_left.join(able, "term").filter(F.col("together") >= MIN_POSTERIOR * F.col("least")).drop("least").join(mentions, "entity"), "pii-pairs")
    shared = term_table(spark, pairs.select("term").distinct())

    def count(batches):
        known, table, total, tokens = {}, shared.value, {}, 0
        for batch in batches:
            for t in batch.column(0):
                if not t.is_valid:
                    continue
                found = _WORD.findall(t.as_py().lower())
                tokens += len(found)
                if not table:
                    continue
                for w in found:
                    on = known.get(w)
                    if on is None:
                        h = term_hash(w)
                        on = known[w] = bool(table[h >> 3] >> (h & 7) & 1)
                    if on:
                        total[w] = total.get(w, 0) + 1
                if len(known) > 400_000:
                    known = {}
        yield pa.RecordBatch.from_arrays([pa.array([None, *total], pa.string()), pa.array([tokens, *total.values()], pa.int64())], ["term", "n"])

    counts = docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    counts = materialise(spark, counts, "pii-counts")
    tokens = counts.filter("term is null").agg(F.max("n_term")).first()[0] or 1
    share = F.least(F.lit(1.0), F.col("together") / F.col("n_term"))
    # P(entity): the share of tokens that stand in its contexts.
    prior = F.least(F.lit(1.0), F.col("n_entity") * (2 * WINDOW) / F.lit(float(tokens)))
    scored = pairs.join(counts, "term").withColumns({"share": share, "prior": prior, "seen": F.col("support") / share})
    scored = scored.withColumn("posterior", (F.col("support") + PSEUDO * F.col("prior")) / (F.col("seen") + PSEUDO)).withColumn("bits", F.log2(F.col("share") / F.col("prior")))
    elsewhere = F.when(F.col("share") < 1, (1 - F.col("share")) * (F.log2(1 - F.col("share")) - F.log2(1 - F.col("prior")))).otherwise(0.0)
    evidence = F.col("seen") * (F.col("share") * F.log2(F.col("share") / F.col("prior")) + elsewhere) - math.log2(tried)
    kept = scored.filter((F.col("posterior") >= MIN_POSTERIOR) & (F.col("bits") >= MIN_BITS) & (evidence >= MIN_BITS))
    return kept.groupBy("term").agg(F.max_by(F.substring_index("entity", ":", 1), F.struct("posterior", "entity")).alias("kind"), F.max("posterior").alias("posterior"), F.max("bits").alias("bits"))


class Taken:
    """Whether a span overlaps one of the given ones, which are in order of their starts."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in spans:
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def __call__(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a


def all_spans(text: str, terms: dict[str, str]) -> tuple[list, list]:
    """Base spans, and those of terms outside them."""
    base = base_spans(text)
    found = []
    if terms:
        found = [(m.start(), m.end(), "term") for m in _WORD.finditer(text) if m[0].lower() in terms]
        if base and found:
            taken = Taken((a, b) for a, b, _ in base)
            found = [s for s in found if not taken(s[0], s[1])]
    return base, found


def own_terms(spark: SparkSession, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """text_key (MD5 of a text), terms: the disclosing terms that each text holds, with the kinds they disclose, by joins."""
    shared = term_table(spark, terms.select("term"))

    def run(batches):
        table = shared.value
        for batch in batches:
            keys, words = [], []
            for t, key in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for w in set(_WORD.findall(t.as_py().lower())) if table and t.is_valid else ():
                    h = term_hash(w)
                    if table[h >> 3] >> (h & 7) & 1:
                        keys.append(key)
                        words.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string())], ["text_key", "term"])

    held = docs.select("text", F.md5("text").alias("text_key")).mapInArrow(run, "text_key string, term string").distinct()
    return held.join(terms.select("term", "kind"), "term").groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("terms"))


def with_terms(spark: SparkSession, docs: DataFrame, terms: DataFrame, name: str) -> tuple[DataFrame, object]:
    """docs, and a broadcast of all terms with their kinds; or, where they are more than TERM_BLOCK, docs with each text's own in the column name, and None."""
    terms = materialise(spark, terms.select("term", "kind"), "pii-terms")
    if terms.count() <= TERM_BLOCK:
        return docs, spark.sparkContext.broadcast({r["term"]: r["kind"] for r in terms.collect()})
    own = own_terms(spark, docs, terms).withColumnRenamed("terms", name)
    keyed = docs.withColumn(f"{name}_key", F.md5("text"))
    return keyed.join(own.withColumnRenamed("text_key", f"{name}_key"), f"{name}_key", "left").select(*docs.columns, name), None


def free_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns or f"{name}_key" in docs.columns:
        name = f"_{name}"
    return name


def listing(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def detect(spark: SparkSession, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans (all), n_term."""
    docs, shared = with_terms(spark, docs.select("doc_id", "text"), terms, "_terms")
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long"

    def run(batches):
        for batch in batches:
            out, own = [], None if shared else batch.column(2)
            for i, t in enumerate(batch.column(1)):
                base, more = all_spans(t.as_py() or "", shared.value if shared else dict(own[i].as_py() or ()))
                kinds = [k for _, _, k in base]
                spans = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))
                out.append((*(kinds.count(k) for k in KINDS[:4]), hashlib.sha256(listing(base).encode()).hexdigest(), listing(spans), len(more)))
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term"])

    return docs.mapInArrow(run, schema)


def redact_text(text: str, spans: list[tuple[int, int, str]], terms: dict[str, str] | None = None) -> str:
    """Each run of overlapping spans becomes the first one's class in brackets; a term is generalised to the class of what it discloses."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= at:
            name = f"{terms[text[a:b].lower()]} term" if kind == "term" and terms else kind
            out += [text[at:a], f"[{name.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with personal data and disclosing terms replaced in text; n_chars, where there is one, follows the new text."""
    names, schema = docs.columns, docs.schema
    docs, shared = with_terms(spark, docs, find_disclosing(spark, docs), free_name(docs, "_terms"))
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches):
        for batch in batches:
            texts, lengths = [], []
            for i, t in enumerate(batch.column(at)):
                text, n = t.as_py(), None
                if text:
                    terms = shared.value if shared else dict(batch.column(len(names))[i].as_py() or ())
                    base, more = all_spans(text, terms)
                    if base or more:
                        text = redact_text(text, base + more, terms)
                        n = len(text)
                texts.append(text)
                lengths.append(n)
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if size >= 0:
                old = batch.column(size).to_pylist()
                cols[size] = pa.array([o if n is None else n for o, n in zip(old, lengths, strict=True)], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, schema)
