"""Problem 6: how many tokens texts have under an existing tokenizer, summed by source, language and domain."""

from __future__ import annotations

import base64
import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm.textcore import BORDER, chunks, range_hashes

#: The ends of contractions that the split pattern takes off.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: White space of the split pattern.
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, DIGIT, SPACE, OTHER, END = 1, 2, 3, 4, 5


def default_vocabulary() -> str:
    """The byte-level BPE that the operators use unless told otherwise."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def _classes() -> np.ndarray:
    first = np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    out[first == ord("L")] = LETTER
    out[first == ord("N")] = DIGIT
    out[SPACES] = SPACE
    out[0xFFFF] = END
    return out


def split_points(points: np.ndarray) -> np.ndarray:
    """Where the pieces of the split pattern begin in code points whose texts each end with a border; borders begin pieces too."""
    kind = _classes()[points]
    n = len(points)
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[1:] |= kind[1:] == END
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))  # the last of white space before a word
    begins[last] = True
    begins[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero((points[:-1] == 0x27) & begins[:-1] & (kind[1:] == LETTER))
    pad = np.concatenate([points, [0, 0]])
    for end in CONTRACTIONS:
        hit = np.ones(len(quote), bool)
        for k, c in enumerate(end):
            hit &= pad[quote + 1 + k] == ord(c)
        at = quote[hit]
        begins[at + 1] = False
        begins[at + 1 + len(end)] = True
        quote = quote[~hit]
    return np.flatnonzero(begins)


class TokenCounter:
    """Counts the tokens of a rank-file BPE exactly, in time linear in the text, without making their ids.

    The vocabulary is an Aho-Corasick automaton; the last token of a prefix's encoding is its longest suffix in
    the vocabulary that may follow the last token of what is left, and a pair of tokens is allowed if its bytes
    encode to just that pair. Equal pieces of the split pattern are counted once per worker.
    """

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.automaton = ahocorasick.Automaton()
        for token in self.ranks:
            self.automaton.add_word(token.decode("latin-1"), token)
        self.automaton.make_automaton()
        self.allowed: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[int, int] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """The encoding of a short piece by its merges, lowest rank first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], sys.maxsize), i) for i in range(len(parts) - 1))
            if rank == sys.maxsize:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, x: bytes, y: bytes) -> bool:
        ok = self.allowed.get((x, y))
        if ok is None:
            ok = self.merge(x + y) == [x, y]
            if len(self.allowed) < 2_000_000:  # memory, not results, as with known pieces
                self.allowed[x, y] = ok
        return ok

    def count_piece(self, piece: bytes) -> int:
        if piece in self.ranks or not piece:
            return int(bool(piece))
        ending: list[list[bytes]] = [[] for _ in piece]
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            ending[end].append(token)
        last: list[bytes] = [b""]
        count = [0]
        for end, tokens in enumerate(ending):
            for token in sorted(tokens, key=len, reverse=True):
                before = end + 1 - len(token)
                if not before or count[before] and self.compatible(last[before], token):
                    last.append(token)
                    count.append(count[before] + 1)
                    break
            else:  # a byte that the vocabulary lacks: a token by itself
                last.append(piece[end : end + 1])
                count.append(count[end] + 1)
        return count[-1]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; null and empty texts have none."""
        odd = {i: x for i, x in enumerate(texts) if x and BORDER in x}
        whole = BORDER.join("" if i in odd else x or "" for i, x in enumerate(texts)) + BORDER
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = split_points(points)
        end = np.append(begin[1:], len(points))
        of = np.searchsorted(np.flatnonzero(points == 0xFFFF), begin)
        real = points[begin] != 0xFFFF
        begin, end, of = begin[real], end[real], of[real]
        keys, first, inverse = np.unique(range_hashes(points, begin, end), return_index=True, return_inverse=True)
        known, counts = self.known, np.zeros(len(keys), np.int64)
        for k, (key, i) in enumerate(zip(keys.tolist(), first.tolist())):
            c = known.get(key)
            if c is None:
                c = self.count_piece(whole[begin[i] : end[i]].encode("utf-8", "surrogatepass"))
                if len(known) < 2_000_000:  # memory, not results: further pieces are counted again
                    known[key] = c
            counts[k] = c
        out = np.bincount(of, counts[inverse], minlength=len(texts))[: len(texts)].astype(np.int64) if len(of) else np.zeros(len(texts), np.int64)
        for i, x in odd.items():  # the border itself is a mark like others: cut there, which joins it to its neighbours' marks
            out[i] = sum(self.count_piece(p.encode("utf-8", "surrogatepass")) for p in _pattern().findall(x))
        return out


@functools.cache
def _pattern():
    import regex

    return regex.compile("'(?:" + "|".join(CONTRACTIONS) + r")| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@functools.cache
def counter(path: str) -> TokenCounter:
    """This worker's counter of a vocabulary file."""
    return TokenCounter(path)


def count_texts(text: pa.Array, path: str) -> np.ndarray:
    out = [np.zeros(0, np.int64)]
    sizes = pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False) if len(text) else []
    for i, j in chunks(sizes):
        out.append(counter(path).count(text.slice(i, j - i).to_pylist()))
    return np.concatenate(out)


def with_tokens(df: DataFrame, column: str, path: str | None = None, name: str = "tokens") -> DataFrame:
    """``df`` with the token count of a string column in its place, or of all strings of an array column together."""
    path = path or default_vocabulary()
    several = df.schema[column].dataType.typeName() == "array"
    kept = [f for f in df.schema.fields if f.name != column]

    def run(batches):
        for b in batches:
            text = b.column(column)
            if several:
                lengths = pc.fill_null(pc.list_value_length(text), 0).to_numpy(zero_copy_only=False)
                counts = np.concatenate([[0], np.cumsum(count_texts(text.flatten(), path))])
                ends = np.cumsum(lengths)
                tokens = counts[ends] - counts[ends - lengths]
            else:
                tokens = count_texts(text, path)
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(tokens.astype(np.int64))], [*[f.name for f in kept], name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.mapInArrow(run, f"{schema}, {name} bigint")


MISSING = "(missing)"
ALL = "(all)"


def tidy(column, joiner: str):
    """One spelling: lower case, trimmed, ``joiner`` between parts; missing and blank values are shown as MISSING."""
    x = F.translate(F.lower(F.trim(column)), "_- ", joiner * 3)
    return F.when(F.length(x) > 0, x).otherwise(F.lit(MISSING))


def row_tokens(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(row_id, source_family, language, scenario_family, tokens): each record once, with the tokens of all its messages, the system message included.

    Spellings are brought together and missing values shown as MISSING; records without messages have no tokens. Rows with
    null row_id are no records.
    """
    said = F.transform(F.filter(F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")), lambda m: m["content"].isNotNull()), lambda m: m["content"])
    flat = rows.where("row_id IS NOT NULL").select(
        "row_id",
        tidy(F.col("provenance.source_family"), "_").alias("source_family"),
        tidy(F.col("language"), "-").alias("language"),
        tidy(F.col("scenario_family"), "_").alias("scenario_family"),
        said.alias("said"),
    )
    return with_tokens(flat, "said", path).dropDuplicates(["row_id"])


def token_totals(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(source_family, language, scenario_family, records, tokens) for every combination of the three or of some of them.

    ALL stands for every value of a column. Counts are those of ``row_tokens``.
    """
    cube = row_tokens(rows, path).cube("source_family", "language", "scenario_family").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"))
    return cube.na.fill(ALL, ["source_family", "language", "scenario_family"])
