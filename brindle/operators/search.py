"""Full-text search: analysis, an index as tables, a query language, BM25, facets, pages and highlights.

An index is three DataFrames: postings (field, term, doc_id, tf, positions, len), lengths (field, doc_id, len) and
values (field, doc_id, value) of numeric and boolean fields. Postings are made document by document, without a shuffle, and
hold the length of the field, so a score needs no other table of documents. A query string is parsed to a small tree and
compiled to joins and aggregates over them; scores are Column arithmetic. An IndexStore keeps indexes under names, with the postings
of each file in the order of their terms: where the query has literal terms, the filter on them skips most of the pages.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, reduce
from itertools import accumulate, chain

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.scalar import nfc
from brindle.functions.stemmer import stem
from brindle.session import scratch_dir

K1, B = 1.2, 0.75

# The stop words.
STOP_WORDS = (
    "a an the and or but if when where how what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing will would can could shall should may might to for of in on at by with from as into through during before after above "
    "below between under again further then once here there not no nor so yet both each few more most other some such only own same too very "
    "just because about up out off over than also any now ever never all every enough rather quite thus per among until while upon across "
    "along around amongst betwixt thru via whereas whereby wherein whereupon wherewith wherewithal"
).split()

# ---- analysis

#: Unicode's default word bounds.
BOUND = regex.compile(r"(?V1w)\b")
#: Fixed value: ASCII punctuation and blanks, which are taken off both ends of a segment.
TRIM = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \t\n\r\x0b\x0c"


def tokenize(text: str) -> list[tuple[str, int]]:
    """(term, position) of the standard tokenizer: the segments between word bounds that are more than blanks and ASCII punctuation.

    Other symbols (arrows, curly quotes, emoji) are tokens and have positions.
    """
    terms = (segment.strip().strip(TRIM).lower() for segment in BOUND.split(unicodedata.normalize("NFC", text)))
    return [(t, i) for i, t in enumerate(filter(None, terms))]


_stem = lru_cache(200_000)(stem)
_stops = frozenset(STOP_WORDS)


def analyze(text: str, stop: bool = True) -> list[tuple[str, int]]:
    """Index terms: tokens without stop words (which leave gaps in the positions), stemmed."""
    return [(_stem(t), i) for t, i in tokenize(text) if not (stop and t in _stops)]


TOKENS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("pos", T.IntegerType())]))


@F.pandas_udf(TOKENS)
def analyzed(texts):
    """Terms and positions of a text column, in Arrow batches."""
    return texts.map(lambda s: [] if s is None else [{"term": t, "pos": i} for t, i in analyze(s)])


#: Blanks of ASCII: there always are word bounds around them, so what stands between them is cut by itself, but for blanks that a mark follows.
_CHUNKS = re.compile(r"[^ \t\n\r\x0b\x0c]+").findall
_MARKED = regex.compile(r"\s[\p{WB=Extend}\p{WB=Format}\p{WB=ZWJ}]").search


def _cut(chunk: str) -> tuple[str | None, ...]:
    """The index terms of a text in NFC; None stands for a stop word."""
    bare = chunk.strip(TRIM)
    if bare.isascii() and bare.isalnum() and len(bare) <= KEPT:
        t = bare.lower()
        return (None if t in _stops else _stem(t),)
    return tuple(None if t in _stops else _stem(t) if len(t) <= KEPT else stem(t) for t, _ in tokenize(chunk))


#: Longer chunks and terms are not kept, as they would fill a worker's memory.
KEPT = 40
_cut_kept = lru_cache(100_000)(_cut)


def _chunks(text: str) -> list[str]:
    """Pieces of a text in NFC whose index terms, in a row, are those of the text."""
    text = unicodedata.normalize("NFC", text)
    return [text] if not text.isascii() and _MARKED(text) else _CHUNKS(text)


def term_positions(text: str) -> dict[str, list[int]]:
    """The terms of analyze() with their positions, in the order in which they first occur."""
    at: dict[str, list[int]] = {}
    i = 0
    for chunk in _chunks(text):
        for t in _cut_kept(chunk) if len(chunk) <= KEPT else _cut(chunk):
            if t is not None:
                if t in at:
                    at[t].append(i)
                else:
                    at[t] = [i]
            i += 1
    return at


def term_number(text: str) -> int:
    """How many terms analyze() gives."""
    return sum(len(terms) - terms.count(None) for terms in (_cut_kept(c) if len(c) <= KEPT else _cut(c) for c in _chunks(text)))


#: A worker hands on what it has when it holds so many postings, so its memory doesn't grow with a batch.
HELD = 50_000
POSTINGS = "array<struct<term:string,tf:bigint,positions:array<int>>>"


def _postings_batch(keys: pa.RecordBatch, rows: list[int], found: list[dict[str, list[int]]]) -> pa.RecordBatch:
    """keys (field, doc_id) of the rows, len and p: the terms found, frequencies and positions."""
    terms = [t for at in found for t in at]
    positions = [p for at in found for p in at.values()]
    tf = [len(p) for p in positions]
    sizes = [len(at) for at in found]
    starts = lambda counts: pa.array(accumulate(counts, initial=0), pa.int32())
    at = pa.ListArray.from_arrays(starts(tf), pa.array(list(chain.from_iterable(positions)), pa.int32()))
    p = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tf, pa.int64()), at], ["term", "tf", "positions"])
    lengths = [sum(map(len, at.values())) for at in found]
    field, doc_id = (c.take(pa.array(rows, pa.int64())) for c in (keys.column("field"), keys.column("doc_id")))
    return pa.RecordBatch.from_arrays([field, doc_id, pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(starts(sizes), p)], ["field", "doc_id", "len", "p"])


def posting_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, rows, found, held = batch.column("text"), [], [], 0
        for i in range(batch.num_rows):
            at = term_positions(text[i].as_py() or "")
            if at:
                rows.append(i)
                found.append(at)
                held += len(at)
            if held >= HELD:
                yield _postings_batch(batch, rows, found)
                rows, found, held = [], [], 0
        if rows:
            yield _postings_batch(batch, rows, found)


def length_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = pa.array([term_number(t.as_py() or "") for t in batch.column("text")], pa.int64())
        out = pa.RecordBatch.from_arrays([batch.column("field"), batch.column("doc_id"), n], ["field", "doc_id", "len"])
        yield out.filter(pc.greater(n, 0))


def analyzed_postings(texts: DataFrame) -> DataFrame:
    """field, doc_id, len and p (POSTINGS) of field, doc_id and text, without what has no terms."""
    key = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("field", "doc_id", "text").mapInArrow(posting_batches, f"field string, doc_id {key}, len bigint, p {POSTINGS}")


def analyzed_lengths(texts: DataFrame) -> DataFrame:
    """field, doc_id and len of field, doc_id and text, without what has no terms: as analyzed_postings(), but nothing else is made."""
    key = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("field", "doc_id", "text").mapInArrow(length_batches, f"field string, doc_id {key}, len bigint")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(tokens: Column) -> Column:
    """(term, tf) of an array of tokens, in the order of the terms: counted within the row, so nothing is shuffled for it."""

    def counted(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        return _let(first, lambda at: F.transform(at, lambda i, k: F.struct(F.element_at(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i).cast("long").alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.when(F.size(tokens) > 0, _let(F.array_sort(tokens), counted)).otherwise(none)


def whitespace_tokens(c: Column) -> Column:
    """The whitespace tokenizer, in builtins."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def without_stop_words(tokens: Column) -> Column:
    """Positions are those before, so gaps remain."""
    kept = F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    return F.filter(kept, lambda x: ~x["term"].isin(*STOP_WORDS))


# ---- the index


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    postings: DataFrame
    lengths: DataFrame
    values: DataFrame
    boosts: dict[str, float]
    #: field, doc_id, len and p, a row for each text: what postings are read from while they aren't stored.
    rows: DataFrame | None = None

    def without(self, ids: DataFrame) -> Index:
        """After documents (doc_id) are deleted."""
        gone = ids.select("doc_id").distinct()
        cut = lambda df: df.join(gone, "doc_id", "left_anti")
        return Index(cut(self.docs), cut(self.postings), cut(self.lengths), cut(self.values), self.boosts, cut(self.rows) if self.rows is not None else None)

    def merged(self, other: Index) -> Index:
        """With other's documents in the place of those of the same id; ids are stable."""
        own = self.without(other.docs)
        both = lambda a, b: a.unionByName(b)
        rows = both(own.rows, other.rows) if own.rows is not None and other.rows is not None else None
        return Index(both(own.docs, other.docs), both(own.postings, other.postings), both(own.lengths, other.lengths), both(own.values, other.values), self.boosts | other.boosts, rows)

    def stats(self) -> DataFrame:
        """docs, tokens and fields."""
        one = self.docs.agg(F.count(F.lit(1)).alias("docs"))
        other = self.lengths.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("tokens"), F.countDistinct("field").alias("fields"))
        return one.crossJoin(F.broadcast(other))


def build(docs: DataFrame, text: list[str], values: list[str] | None = None, boosts: dict[str, float] | None = None) -> Index:
    """An index of docs (doc_id and the named columns), one document a row."""
    values = values or []
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in text]))
    texts = docs.select("doc_id", fields.alias("f")).select("doc_id", "f.field", "f.text")
    rows, lengths = analyzed_postings(texts), analyzed_lengths(texts)
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in values]
    none = docs.sparkSession.createDataFrame([], "field string, doc_id long, value string")
    held = docs.select(F.explode(F.array(*pairs)).alias("v"), "doc_id").select("v.field", "doc_id", "v.value").where("value IS NOT NULL") if pairs else none
    return Index(docs.select("doc_id"), _exploded(rows), lengths, held, boosts or {}, rows)


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("field", "doc_id", "len", F.explode("p").alias("p")).select("field", "p.term", "doc_id", "p.tf", "p.positions", "len")


class IndexStore:
    """Indexes by name, in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self) -> list[str]:
        fs, p = self._fs(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(self._fs(f"{self.path}/{s.getPath().getName()}/boosts")[1])) if fs.exists(p) else []

    def save(self, name: str, index: Index) -> Index:
        """Writes an index; the boosts come last and make it whole.

        Each task sorts the postings that it has by term and writes them without a shuffle, so a filter on terms reads few
        pages of a file. Lengths are in the same files, as rows without a term, so texts are analyzed once.
        """
        if name in self.names():
            raise ValueError(f"index {name} exists")
        if index.rows is not None:
            every = _exploded(index.rows.withColumn("p", F.concat(F.array(F.lit(None).cast(POSTINGS[len("array<") : -1])), "p")))
        else:
            every = index.postings.unionByName(index.lengths, allowMissingColumns=True)
        every.sortWithinPartitions("term", "field", "doc_id").write.mode("overwrite").parquet(f"{self.path}/{name}/postings")
        for part in ("docs", "values"):
            getattr(index, part).write.mode("overwrite").parquet(f"{self.path}/{name}/{part}")
        self.spark.createDataFrame([(json.dumps(index.boosts),)], "boosts string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}/boosts")
        return self.open(name)

    def open(self, name: str) -> Index:
        if name not in self.names():
            raise ValueError(f"no index {name}")
        part = lambda x: self.spark.read.parquet(f"{self.path}/{name}/{x}")
        boosts = json.loads(self.spark.read.text(f"{self.path}/{name}/boosts").head()[0])
        every = part("postings")
        lengths = every.where("term IS NULL").select("field", "doc_id", "len")
        if (old := self._fs(f"{self.path}/{name}/lengths"))[0].exists(old[1]):  # of indexes that were written with a table of lengths
            lengths = part("lengths")
        return Index(part("docs"), every.where("term IS NOT NULL"), lengths, part("values"), boosts)

    def drop(self, name: str) -> None:
        if name not in self.names():
            raise ValueError(f"no index {name}")
        fs, p = self._fs(f"{self.path}/{name}")
        fs.delete(p, True)


def bm25(tf, length, average, n, df) -> Column:
    """The score of a term in a field; columns or their names. Without an average length, the length counts for nothing."""
    tf, length, average, n, df = (F.col(x) if isinstance(x, str) else x for x in (tf, length, average, n, df))
    idf = F.ln((n - df + 0.5) / (df + 0.5) + 1)
    norm = F.when(average > 0, K1 * (1 - B + B * length / average)).otherwise(F.lit(K1))
    gain = F.when(average > 0, tf * (K1 + 1)).otherwise(tf)
    return idf * gain / (tf + norm)


# ---- the query language


@dataclass(frozen=True)
class Term:
    text: str
    field: str | None = None


@dataclass(frozen=True)
class Phrase:
    text: str
    field: str | None = None


@dataclass(frozen=True)
class Prefix:
    text: str
    field: str | None = None


@dataclass(frozen=True)
class Fuzzy:
    text: str
    distance: int = 2
    field: str | None = None


@dataclass(frozen=True)
class Between:
    field: str
    low: str
    high: str
    inclusive: bool = True


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class Negated:
    part: object


@dataclass(frozen=True)
class Every:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


class QueryError(ValueError):
    pass


_LEX = re.compile(
    r"""\s*(?:(?P<open>\()|(?P<close>\))|(?P<minus>-(?=\S))|(?:(?P<field>[\w.]+):(?=\S))?(?:
    "(?P<phrase>[^"]*)"|(?P<square>\[)\s*(?P<lo>\S+)\s+TO\s+(?P<hi>[^\]\s]+)\s*\]|(?P<curly>\{)\s*(?P<lo2>\S+)\s+TO\s+(?P<hi2>[^}\s]+)\s*\}|(?P<word>[^\s()"]+)))""",
    re.VERBOSE,
)


def parse(text: str) -> object:
    """The tree of a query: implicit AND, AND, OR, NOT, -x, parentheses, "phrase", field:x, pre*, term~n, field:[a TO b], * and *:*."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"can't read {text[at:]!r}")
        tokens.append({k: v for k, v in m.groupdict().items() if v is not None})
        at = m.end()
    if not tokens:
        return All()
    tree, rest = _either(tokens, 0)
    if rest < len(tokens):
        raise QueryError("a parenthesis too many")
    return tree


def _word(tokens: list[dict], i: int) -> str | None:
    return tokens[i].get("word") if i < len(tokens) and "field" not in tokens[i] else None


def _either(tokens: list[dict], i: int) -> tuple[object, int]:
    parts = []
    while True:
        part, i = _every(tokens, i)
        parts.append(part)
        if _word(tokens, i) != "OR":
            return (parts[0] if len(parts) == 1 else Either(tuple(parts))), i
        i += 1


def _every(tokens: list[dict], i: int) -> tuple[object, int]:
    parts = []
    while i < len(tokens) and "close" not in tokens[i] and _word(tokens, i) != "OR":
        if _word(tokens, i) == "AND":
            i += 1
            continue
        part, i = _unary(tokens, i)
        parts.append(part)
    if not parts:
        raise QueryError("nothing between operators")
    return (parts[0] if len(parts) == 1 else Every(tuple(parts))), i


def _unary(tokens: list[dict], i: int) -> tuple[object, int]:
    if i >= len(tokens):
        raise QueryError("the query ends too early")
    t = tokens[i]
    if "minus" in t or _word(tokens, i) == "NOT":
        part, i = _unary(tokens, i + 1)
        return Negated(part), i
    if "open" in t:
        part, i = _either(tokens, i + 1)
        if i >= len(tokens) or "close" not in tokens[i]:
            raise QueryError("a parenthesis isn't closed")
        return part, i + 1
    field, word = t.get("field"), t.get("word")
    if "phrase" in t:
        return Phrase(t["phrase"], field), i + 1
    if "square" in t or "curly" in t:
        if not field:
            raise QueryError("a range needs a field")
        return Between(field, t.get("lo", t.get("lo2")), t.get("hi", t.get("hi2")), "square" in t), i + 1
    if word is None:
        raise QueryError("an operand is missing")
    if word[0] in "[{" or word[-1] in "]}":
        raise QueryError(f"not a range: {word}")
    if word in ("*", "*:*"):
        return All(), i + 1
    if m := re.fullmatch(r"(.+)~(\d*)", word):
        return Fuzzy(m[1], int(m[2] or 2), field), i + 1
    if word.endswith("*"):
        return Prefix(word[:-1], field), i + 1
    return Term(word, field), i + 1


# ---- evaluation: each node gives (doc_id, score)


def _query_term(text: str) -> str:
    return stem(unicodedata.normalize("NFC", text).lower())


def _weighted(index: Index, c: Column) -> Column:
    for f, w in index.boosts.items():
        c = F.when(F.col("field") == f, c * w).otherwise(c)
    return c


def _scored(index: Index, hits: DataFrame) -> DataFrame:
    """hits: field, term, doc_id, tf. Terms are scored one by one and summed."""
    n = index.docs.agg(F.count(F.lit(1)).alias("n"))
    average = index.lengths.groupBy("field").agg(F.avg("len").alias("average"))
    df = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(df, ["field", "term"]).join(F.broadcast(average), "field").crossJoin(F.broadcast(n))
    return rows.groupBy("doc_id").agg(F.sum(_weighted(index, bm25("tf", "len", "average", "n", "df"))).alias("score"))


def _reads(q: object, term: Column) -> Column | None:
    """Whether a leaf of the tree reads the postings of a term; None if it reads none."""
    if isinstance(q, Term):
        fits = term == _query_term(q.text)
    elif isinstance(q, Prefix):
        fits = term.startswith(_query_term(q.text))
    elif isinstance(q, Fuzzy):
        word = _query_term(q.text)
        # Lengths that differ by more can't be that close; telling so costs less.
        fits = F.length(term).between(len(word) - q.distance, len(word) + q.distance) & (F.levenshtein(term, F.lit(word), q.distance) >= 0)
    elif isinstance(q, Phrase) and (words := {t for t, _ in analyze(q.text)}):
        fits = term.isin(*words)
    else:
        return None
    return (F.col("field") == q.field) & fits if q.field else fits


def _leaves(q: object) -> list[object]:
    return [x for p in q.parts for x in _leaves(p)] if isinstance(q, Every | Either) else _leaves(q.part) if isinstance(q, Negated) else [q]


def narrowed(index: Index, q: object) -> Index:
    """index for the evaluation of q. If it isn't stored, its texts are analyzed once, here, and what q reads of them is written
    to a new folder, as an evaluation reads postings and lengths again and again.
    """
    read = lambda x: [t for t in (_reads(leaf, x["term"]) for leaf in _leaves(q)) if t is not None]
    if index.rows is None or not read({"term": F.lit("")}):
        return index
    spark, path = index.rows.sparkSession, scratch_dir(index.rows.sparkSession)
    index.rows.withColumn("p", F.filter("p", lambda x: reduce(lambda a, b: a | b, read(x)))).write.parquet(path)
    rows = spark.read.schema(index.rows.schema).parquet(path)
    return replace(index, postings=_exploded(rows), lengths=rows.select("field", "doc_id", "len"), rows=None)


def _less(back: Column):
    return lambda p: p - back


def _phrase(index: Index, q: Phrase) -> DataFrame:
    """Consecutive positions; a stop word leaves its place open. Scored by the sum of all its terms' frequencies, as if one document had it."""
    terms = analyze(q.text)
    if not terms:
        return index.docs.limit(0).withColumn("score", F.lit(0.0))
    first = terms[0][1]
    rows = index.postings.where(_reads(q, F.col("term")))
    per = rows.groupBy("field", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.collect_list(F.struct("term", "tf")).alias("tfs"), F.max("len").alias("len"))
    starts = None
    for t, i in terms:
        back = F.lit(i - first)
        here = F.transform(F.coalesce(F.try_element_at("at", F.lit(t)), F.array().cast("array<int>")), _less(back))
        starts = here if starts is None else F.array_intersect(starts, here)
    tf_of = F.map_from_entries("tfs")
    total = sum((F.coalesce(F.try_element_at(tf_of, F.lit(t)), F.lit(0)) for t, _ in terms), F.lit(0))
    found = per.where(F.size(starts) > 0).select("field", "doc_id", "len", total.alias("tf"))
    n = index.docs.agg(F.count(F.lit(1)).alias("n"))
    average = index.lengths.groupBy("field").agg(F.avg("len").alias("average"))
    found = found.join(F.broadcast(average), "field").crossJoin(F.broadcast(n))
    return found.groupBy("doc_id").agg(F.sum(_weighted(index, bm25("tf", "len", "average", "n", F.lit(1)))).alias("score"))


def phrase_documents(at: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id of the documents of at (doc_id, pos, term) where the terms follow one another.

    Each occurrence votes for the place where the phrase would begin, so no positions are joined with each other.
    """
    votes = [F.when(F.col("term") == t, F.col("pos") - i) for i, t in enumerate(terms)]
    begin = at.where(F.col("term").isin(*terms)).select("doc_id", F.explode(F.filter(F.array(*[F.struct(v.alias("b"), F.lit(i).alias("i")) for i, v in enumerate(votes)]), lambda x: x["b"].isNotNull())).alias("x"))
    return begin.groupBy("doc_id", "x.b").agg(F.countDistinct("x.i").alias("n")).where(F.col("n") == len(terms)).select("doc_id").distinct()


def evaluate(index: Index, q: object) -> DataFrame:
    """doc_id and score of the documents that match."""
    if isinstance(q, All):
        return index.docs.withColumn("score", F.lit(1.0))
    if isinstance(q, Term | Prefix | Fuzzy):
        return _scored(index, index.postings.where(_reads(q, F.col("term"))))
    if isinstance(q, Phrase):
        return _phrase(index, q)
    if isinstance(q, Between):
        value, number = F.col("value"), F.col("value").try_cast("double")
        try:
            low, high = F.lit(float(q.low)), F.lit(float(q.high))
        except ValueError:
            low = high = F.lit(None).cast("double")
        within = lambda v, a, b: v.between(a, b) if q.inclusive else (v > a) & (v < b)
        numeric = number.isNotNull() & low.isNotNull() & high.isNotNull()
        fits = F.when(numeric, within(number, low, high)).otherwise(within(value, F.lit(q.low), F.lit(q.high)))
        return index.values.where((F.col("field") == q.field) & fits).select("doc_id").distinct().withColumn("score", F.lit(1.0))
    if isinstance(q, Negated):
        return index.docs.join(evaluate(index, q.part), "doc_id", "left_anti").withColumn("score", F.lit(1.0))
    if isinstance(q, Either):
        parts = [evaluate(index, p).select("doc_id", "score") for p in q.parts]
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        return union.groupBy("doc_id").agg(F.sum("score").alias("score"))
    if isinstance(q, Every):
        yes = [p for p in q.parts if not isinstance(p, Negated)]
        if not yes:
            return index.docs.limit(0).withColumn("score", F.lit(0.0))
        out = evaluate(index, yes[0])
        for p in yes[1:]:
            other = evaluate(index, p).withColumnRenamed("score", "_s")
            out = out.join(other, "doc_id").select("doc_id", (F.col("score") + F.col("_s")).alias("score"))
        for p in q.parts:
            if isinstance(p, Negated):
                out = out.join(evaluate(index, p.part), "doc_id", "left_anti")
        return out
    raise TypeError(q)


def found(index: Index, text: str) -> DataFrame:
    """doc_id and score of the documents that match a query string."""
    q = parse(text)
    return evaluate(narrowed(index, q), q)


def search(index: Index, text: str, limit: int = 10, after: tuple[float, int] | None = None, offset: int = 0) -> DataFrame:
    """The best documents; the smaller id first among equals. after: the (score, doc_id) that ended the page before."""
    hits = found(index, text)
    if after is not None:
        s, i = after
        hits = hits.where((F.col("score") < s) | ((F.col("score") == s) & (F.col("doc_id") > i)))
    return hits.orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)


def totals(index: Index, text: str) -> DataFrame:
    return found(index, text).agg(F.count(F.lit(1)).alias("total_hits"), F.max("score").alias("max_score"))


def facets(docs: DataFrame, field: str, most: int | None = None) -> DataFrame:
    """Documents of each value of a field, the most frequent first; the smaller value first among equals."""
    out = docs.groupBy(field).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), field).limit(most) if most is not None else out


def faceted(index: Index, docs: DataFrame, text: str, field: str, most: int) -> DataFrame:
    hits = found(index, text).select("doc_id")
    return facets(docs.join(hits, "doc_id", "left_semi"), field, most)


def suggestions(index: Index, prefix: str, most: int = 10) -> DataFrame:
    """Terms with that beginning, those of most documents first."""
    per = index.postings.where(F.col("term").startswith(prefix.lower())).groupBy("term").agg(F.countDistinct("doc_id").alias("n"))
    return per.orderBy(F.desc("n"), "term").limit(most)


def highlight(text: str, terms: list[str], width: int = 150, marks: tuple[str, str] = ("**", "**"), most: int = 3) -> list[str]:
    """Up to ``most`` windows of the text around hits of the terms, all hits marked; its head where there is none."""
    found = [m.span() for t in terms if t for m in re.finditer(re.escape(t), text, re.IGNORECASE)]
    spans: list[list[int]] = []
    for a, z in sorted(found):
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], z)
        else:
            spans.append([a, z])
    if not spans:
        return [text[:width] + ("..." if len(text) > width else "")] if text else []
    out, done = [], -1
    for a, z in spans:
        if len(out) == most:
            break
        if z <= done:
            continue
        lo = max(0, min(a - (width - (z - a)) // 2, a))
        done = max(z, min(len(text), lo + width))
        inner = [s for s in spans if lo <= s[0] and s[1] <= done]
        piece, at = [], lo
        for x, y in inner:
            piece += [text[at:x], marks[0], text[x:y], marks[1]]
            at = y
        piece.append(text[at:done])
        out.append(("..." if lo else "") + "".join(piece) + ("..." if done < len(text) else ""))
    return out


def with_highlights(docs: DataFrame, text: str, query: str, width: int = 150) -> DataFrame:
    """docs with snippets, of the words of a query."""
    terms = [w for w in re.findall(r"\w+", query.lower()) if w not in ("and", "or", "not", "to")]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts):
        return texts.map(lambda s: [] if s is None else highlight(s, terms, width))

    return docs.withColumn("snippets", cut(text))


def normalised(c: str) -> Column:
    return nfc(c)
