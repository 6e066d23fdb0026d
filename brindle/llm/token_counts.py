"""Token counts by heap-and-linked-list byte-pair merging.

The text is cut into pre-tokens; the symbols of each (its bytes) form a linked list, and a
heap gives the adjacent pair of lowest rank, leftmost first. Each pair that is merged takes
one symbol away, so the count is the initial symbols minus the merges; no identifiers are made.

Defined results: a null or empty text has 0 tokens and 0 bytes; repeated rows give repeated
rows; an empty table gives an empty one; other columns pass through untouched unless they
have a name that the operator gives, which then is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import TwoGenerations

#: Fixed value: the published pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these ranges the classes of two Unicode versions might differ; such texts are cut by the library.
COMMON = r"\x00-\x1b\x20-ɏͰ-ӿ‐-‧‰-⁞€"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable, else the next character from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PairMerger:
    """Counts tokens with the ranks of one byte-level vocabulary file."""

    def __init__(self, path: str, cache: int = 1_000_000):
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only plain byte-level vocabularies are counted by merging")
        if model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain pair merging is counted")
        ids, shown = model["vocab"], byte_alphabet()
        self.first = [ids[shown[b]] for b in range(256)]
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.rank_of = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(merges)}.get
        self.made = [ids[a + b] for a, b in merges]
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.cut = regex.compile(PATTERN).findall
        self.rare = regex.compile(f"[^{COMMON}]").search
        self.library = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        back = {c: b for b, c in enumerate(shown)}
        self.raw = lambda piece: bytes(back[c] for c in piece)
        self.pieces = TwoGenerations(lambda piece: self.merged(piece.encode()), cache)
        self.after_space = TwoGenerations(lambda word: self._cut_and_count(" " + word), cache)
        self.first_in_line = TwoGenerations(self._cut_and_count, cache // 8)
        self.line_end = self.merged(b"\n")
        self.space_run = re.compile(r"\s\s|^\s|\s\Z").search

    def merged(self, piece: bytes) -> int:
        """Symbols of the piece that are left when no pair can be merged."""
        n = left = len(piece)
        if n < 2:
            return n
        rank_of, made, first = self.rank_of, self.made, self.first
        ids = [first[b] for b in piece]
        ranks = [rank_of(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]  # of the pair that begins at each symbol
        ranks.append(-1)
        heap = [r << 40 | i for i, r in enumerate(ranks) if r >= 0]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            e = heapq.heappop(heap)
            i, r = e & 0xFFFFFFFFFF, e >> 40
            if ranks[i] != r:
                continue  # a symbol of that pair has been merged since
            j = after[i]
            ids[i] = new = made[r]
            ranks[j] = ranks[i] = -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                ranks[i] = r = rank_of(new << 32 | ids[k], -1)
                if r >= 0:
                    heapq.heappush(heap, r << 40 | i)
            h = before[i]
            if h >= 0:
                ranks[h] = r = rank_of(ids[h] << 32 | new, -1)
                if r >= 0:
                    heapq.heappush(heap, r << 40 | h)
        return left

    def _cut_and_count(self, text: str) -> int:
        if self.rare(text):
            return sum(self.merged(self.raw(piece)) for piece, _ in self.library(text))
        return sum(map(self.pieces.__getitem__, self.cut(text)))

    def _plain(self, text: str) -> int:
        """A single space or line end between other characters always begins a pre-token, so words are counted one by one."""
        if self.space_run(text):
            return self._cut_and_count(text)
        n = -self.line_end
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            n += self.line_end + self.first_in_line[first] + sum(map(self.after_space.__getitem__, rest))
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not (found := self.special.findall(text)):
            return self._plain(text)
        return len(found) + sum(self._plain(x) for x in self.special.split(text) if x)


_mergers: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    """One for each worker process."""
    if path not in _mergers:
        _mergers[path] = PairMerger(path)
    return _mergers[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with a long column of token counts. path: a vocabulary file that every worker can open."""
    import pyarrow as pa

    docs = docs.drop(out) if out in docs.columns else docs
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(path).count
        for b in batches:
            n = pa.array((count(x.as_py()) for x in b.column(b.schema.get_field_index(text))), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n], [*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def op7_token_counts(spark, sf_dir: str, limit: int = 1024) -> DataFrame:
    """Tokens of every whole text, as the library counts them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
