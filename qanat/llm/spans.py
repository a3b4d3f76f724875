"""Problem 2: long passages that stand word for word in several records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm.runtime import cut, maybe_in, membership_filter, spoken
from qanat.llm.textcore import chunks, least_runs, mix, range_hashes, window_hashes

#: Tokens of a phrase; a span of n tokens always holds the phrase with the least hash among its n - PHRASE + 1.
PHRASE = 16
#: Phrases of one automaton, and bytes of the messages that one task streams through it.
SHARD, STREAM = 10_000, 4 << 20


def tokens(content: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, message number, first byte, end) of each run between space, tab and line feed; bytes count from the array's first."""
    if isinstance(content, pa.ChunkedArray):
        content = content.combine_chunks()
    if len(content) == 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    offsets = np.frombuffer(content.buffers()[1], np.int32, len(content) + 1, 4 * content.offset).astype(np.int64)
    raw = np.frombuffer(content.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~((raw == 32) | (raw == 9) | (raw == 10))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.append(False, inside[:-1]) & ~edge[:-1] if len(raw) else inside
    after = np.append(inside[1:], False) & ~edge[1:] if len(raw) else inside
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return range_hashes(raw, start, end), np.searchsorted(offsets, start, "right") - 1, start, end


def pieces(b: pa.RecordBatch):
    """(slice, its token hashes, message numbers, starts, ends) of bounded size."""
    content = b.column("content")
    sizes = np.diff(np.frombuffer(content.buffers()[1], np.int32, len(content) + 1, 4 * content.offset)) if len(content) else []
    for i, j in chunks(sizes):
        part = b.slice(i, j - i)
        yield (part, *tokens(part.column("content")))


def sharded(phrases: DataFrame, likely: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(phrase, shard, salt) and (content, row_id, turn, part, salt): phrases of each automaton and the messages it reads.

    From (phrase, home) and (content, row_id, turn, homes). A shard has as many salts as its messages have STREAM bytes.
    """
    shards = phrases.count() // SHARD + 1
    phrases = phrases.select("phrase", F.pmod("home", F.lit(shards)).cast("int").alias("shard"))
    routed = likely.select("content", "row_id", "turn", F.explode(F.array_distinct(F.transform("homes", lambda x: F.pmod(x, F.lit(shards)).cast("int")))).alias("part"))
    salts = F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("content")) / F.lit(STREAM))).cast("int")
    sizes = cut(routed.groupBy("part").agg(salts.alias("salts")))
    spread = phrases.join(sizes, F.col("shard") == F.col("part")).select("phrase", "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return spread, routed.join(sizes, "part").select("content", "row_id", "turn", "part", F.pmod(F.xxhash64("row_id", "turn"), "salts").cast("int").alias("salt"))


def shared_windows(rows: DataFrame, n: int = 40) -> DataFrame:
    """(row_id, turn, start): first tokens of all n-token windows of user and assistant messages that also stand in one message of another record.

    Tokens are the runs between space, tab and line feed of the content as it is, compared byte for byte. Phrases (the
    least of each window) that recur are spelled by the first and the last record that have them, compiled into sharded
    Aho-Corasick automata, and every message that holds one of a shard's phrases is streamed through that shard's; all places come
    from the automata. Windows around them are then compared by 128 bits. Messages under n tokens have no window.
    Only hashes of phrases leave the first pass, about a thirteenth of the tokens.

    A phrase belongs to the shard of the first message that has it, so a copied passage meets one shard and not one for
    each of its phrases. A shard is copied once for every STREAM bytes of its own messages: automata grow in proportion to the text.
    """
    said = spoken(rows).drop("role").withColumn("k", F.xxhash64("row_id", "turn"))

    def mark(batches):
        for b in batches:
            for part, h, of, _, _ in pieces(b):
                at, g = least_runs(h, of, PHRASE, n)
                key = np.unique(np.stack([of[at], g.view(np.int64)]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
                own = pa.array(key[0].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key[1].astype(np.int64)), part.column("row_id").take(own), part.column("turn").take(own)], ["anchor", "row_id", "turn"])

    marks = cut(said.mapInArrow(mark, "anchor bigint, row_id bigint, turn bigint"))
    place = F.struct("row_id", "turn")
    recurring = marks.groupBy("anchor").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x.row_id <> y.row_id")
    met = marks.join(recurring, "anchor").select("row_id", "turn", F.struct("anchor", F.xxhash64("x").alias("home"), (place.eqNullSafe(F.col("x")) | place.eqNullSafe(F.col("y"))).alias("spells")).alias("a"))
    held = cut(met.groupBy("row_id", "turn").agg(F.collect_set("a").alias("a")))  # at most one per token of a message
    packed = membership_filter(held.select(F.xxhash64("row_id", "turn")))

    def pick(batches):
        for b in batches:
            yield b.filter(pa.array(maybe_in(packed.value, b.column("k").to_numpy(zero_copy_only=False)))).select(["row_id", "turn", "content"])

    likely = said.mapInArrow(pick, "row_id bigint, turn bigint, content string").dropDuplicates(["row_id", "turn"]).join(held, ["row_id", "turn"])
    likely = cut(likely.select("content", "row_id", "turn", F.transform("a", lambda a: a["home"]).alias("homes"), F.transform(F.filter("a", lambda a: a["spells"]), lambda a: F.struct(a["anchor"], a["home"])).alias("a")))

    def spell(batches):
        for b in batches:
            for part, h, of, start, end in pieces(b):
                lists = part.column("a")
                sizes = np.diff(lists.offsets.to_numpy())
                inner = lists.flatten()
                anchor, home = (inner.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "home"))
                if not len(anchor):
                    continue
                asked = np.stack([np.repeat(np.arange(len(sizes)), sizes), anchor])
                order = np.lexsort(asked)
                asked, home = asked[:, order], home[order]
                g = window_hashes(h, PHRASE).view(np.int64)
                key, first = np.unique(np.stack([of[: len(g)], g]), axis=1, return_index=True)  # one place of each phrase of a message spells it
                both = np.concatenate([key, asked], axis=1)
                _, code = np.unique(both, axis=1, return_inverse=True)
                code = code.ravel()
                where = np.searchsorted(code[: key.shape[1]], code[key.shape[1] :])
                where = first[where]
                raw = np.frombuffer(part.column("content").buffers()[2], np.uint8)
                shift = int(np.frombuffer(part.column("content").buffers()[1], np.int32, 1, 4 * part.column("content").offset)[0])
                spelled = [b" ".join(raw[shift + i : shift + j].tobytes() for i, j in zip(start[p : p + PHRASE], end[p : p + PHRASE])).decode() for p in where]
                yield pa.RecordBatch.from_arrays([pa.array(spelled, pa.string()), pa.array(home)], ["phrase", "home"])

    phrases = cut(likely.where("size(a) > 0").select("content", "a").mapInArrow(spell, "phrase string, home bigint").distinct())
    spread, routed = sharded(phrases, likely)

    def stream(left: pa.Table, right: pa.Table) -> pa.Table:
        import ahocorasick

        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        if left.num_rows and right.num_rows:
            automaton = ahocorasick.Automaton()
            for p in left.column("phrase").to_pylist():
                automaton.add_word(f" {p} ", len(p) + 2)
            automaton.make_automaton()
            for b in right.to_batches():
                for part, h, of, _, _ in pieces(b):
                    plain = pc.utf8_trim(pc.replace_substring_regex(part.column("content"), "[ \t\n]+", " "), " ")
                    whole = "".join(f" {x} \n" for x in plain.to_pylist())  # no phrase holds a line feed
                    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
                    first = np.flatnonzero((points[:-1] == 32) & (points[1:] != 10))  # the space before each token
                    hit = np.fromiter((e - size + 1 for e, size in automaton.iter(whole)), np.int64)
                    at = np.unique(np.searchsorted(first, hit))
                    low, high = np.searchsorted(of, of[at], "left"), np.searchsorted(of, of[at], "right")
                    at, low, high = (x[high - low >= n] for x in (at, low, high))
                    use = np.zeros(len(h) + 1, np.int64)
                    np.add.at(use, np.maximum(low, at + PHRASE - n), 1)
                    np.add.at(use, np.minimum(at, high - n) + 1, -1)
                    w = np.flatnonzero(np.cumsum(use)[:-1] > 0)
                    if len(w):
                        own = of[w]
                        row, turn = (part.column(c).to_numpy(zero_copy_only=False)[own] for c in ("row_id", "turn"))
                        for col, v in zip(out, (window_hashes(h, n)[w].view(np.int64), window_hashes(mix(h ^ np.uint64(0xA5A5)), n)[w].view(np.int64), row, turn, w - np.searchsorted(of, own, "left"))):
                            col.append(v)
        return pa.table(dict(zip(("w1", "w2", "row_id", "turn", "start"), (np.concatenate(c).astype(np.int64) for c in out))))

    windows = spread.groupBy("shard", "salt").cogroup(routed.groupBy("part", "salt")).applyInArrow(stream, "w1 bigint, w2 bigint, row_id bigint, turn bigint, start bigint")
    windows = cut(windows)
    shared = windows.groupBy("w1", "w2").agg(F.min("row_id").alias("x"), F.max("row_id").alias("y")).where("x <> y").select("w1", "w2")
    return windows.join(shared, ["w1", "w2"], "left_semi").select("row_id", "turn", "start").distinct()


def shared_messages(rows: DataFrame, n: int = 40) -> DataFrame:
    """(row_id, turn, tokens): messages with a shared window and how many of their tokens lie in shared windows."""
    from pyspark.sql import Window

    w = Window.partitionBy("row_id", "turn").orderBy("start")  # within one message
    cover = F.least(F.lit(n), F.coalesce(F.lead("start").over(w) - F.col("start"), F.lit(n)))
    return shared_windows(rows, n).withColumn("own", cover).groupBy("row_id", "turn").agg(F.sum("own").cast("bigint").alias("tokens"))


def shared_shares(rows: DataFrame, n: int = 40) -> DataFrame:
    """(row_id, tokens, shared_tokens, share): for every record, how much of its user and assistant text stands elsewhere. A record without tokens has a null share."""
    ids = rows.where("row_id IS NOT NULL").select("row_id", "messages")
    own = F.aggregate(
        F.filter(F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")), lambda m: m["role"].isin("user", "assistant") & m["content"].isNotNull()),
        F.lit(0).cast("bigint"),
        lambda a, m: a + F.size(F.filter(F.split(m["content"], "[ \t\n]+"), lambda x: x != "")),
    )
    total = ids.select("row_id", own.alias("tokens")).groupBy("row_id").agg(F.max("tokens").alias("tokens"))
    shared = shared_messages(rows, n).groupBy("row_id").agg(F.sum("tokens").alias("shared_tokens"))
    out = total.join(shared, "row_id", "left").na.fill(0, ["shared_tokens"])
    return out.withColumn("share", F.when(F.col("tokens") > 0, F.col("shared_tokens") / F.col("tokens")))
