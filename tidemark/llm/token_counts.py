"""Token counts by a tokenizer that is compiled to a deterministic transducer.

The tokenizer is byte-pair encoding with word ends. Its transducer reads the bytes of one word, the last one as a symbol
of its own. A state holds every vocabulary entry that is under way: its place in the trie, the token that ends before it,
and its token count against that of the state. Two tokens may stand side by side only if their joint encoding is just
these two, so at every byte exactly one entry can end, and a transition carries the tokens that it adds (fewer than none
where a merge swallows some). States and transitions are compiled when first met and then looked up.

At ASCII white space the transducer is back at its start, whatever came before. So the state map of a chunk of text is a
piece before its first white space, whose count depends on the state at entry; a constant; and the piece after its last
white space, which is the state at exit. Chunks of a long text are read by different tasks. A running sum of chunks with
white space (the prefix scan) composes their maps: it says which pieces meet, and each meeting is counted once.

Defined results: a null text is empty and has no bytes and no tokens. Rows that repeat are counted apart. A null doc_id
is kept. An empty table gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import normalizers

from .common import slices

WORD_END = 1 << 20


class WordTransducer:
    """The number of tokens of one word of bytes, for merges with an end-of-word mark."""

    def __init__(self, model: dict, most_states: int = 200_000):
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        self.most_states = most_states
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        spelled: dict[int, tuple[int, ...]] = {}
        self.symbol = [vocab[c] for c in byte_alphabet()]
        self.last = [vocab[c + end] for c in byte_alphabet()]
        for s in (*self.symbol, *self.last):
            spelled[s] = (s,)
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, ab = vocab[left], vocab[right], vocab[left + right]
            self.ranks.setdefault((a, b), (rank, ab))
            if a in spelled and b in spelled:
                spelled.setdefault(ab, spelled[a] + spelled[b])
        self.spelled = spelled
        self.step: dict[tuple[int, int], int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        for token, symbols in spelled.items():
            node = 0
            for s in symbols:
                if (node, s) not in self.step:
                    self.step[node, s] = nodes
                    nodes += 1
                node = self.step[node, s]
            self.token_at[node] = token
        self.inner = {node for node, _ in self.step}
        self.beside: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[tuple[int, int, int], ...]] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def _merged(self, symbols: tuple[int, ...]) -> list[int]:
        parts = list(symbols)
        while len(parts) > 1:
            best = min(((self.ranks[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [self.ranks[parts[i], parts[i + 1]][1]]
        return parts

    def _fits(self, left: int, right: int) -> bool:
        if (left, right) not in self.beside:
            both = [right] if left < 0 else [left, right]
            self.beside[left, right] = self._merged(sum((self.spelled[t] for t in both), ())) == both
        return self.beside[left, right]

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        ahead = [(node, left, count) for at, left, count in self.states[state] if (node := self.step.get((at, symbol))) is not None]
        ends = [(token, count + 1) for node, left, count in ahead if (token := self.token_at.get(node)) is not None and self._fits(left, token)]
        token, added = ends[0]
        alive = (*((node, left, count - added) for node, left, count in ahead if node in self.inner), (0, token, 0))
        number = self.number.setdefault(alive, len(self.states))
        if number == len(self.states):
            self.states.append(alive)
        self.moves[state * WORD_END + symbol] = number, added
        return number, added

    def count(self, word: bytes) -> int:
        if len(self.states) > self.most_states:
            self._forget()
        state = total = 0
        moves, symbols = self.moves, self.symbol
        for byte in word[:-1]:
            move = moves.get(state * WORD_END + symbols[byte])
            state, added = move or self._compile(state, symbols[byte])
            total += added
        symbol = self.last[word[-1]]
        move = moves.get(state * WORD_END + symbol)
        return total + (move or self._compile(state, symbol))[1]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class PieceCounter(dict):
    """Tokens of a piece of text without ASCII white space (as UTF-8), kept until there are too many pieces
    (of two generations, the older is then dropped)."""

    def __init__(self, tokenizer_json: str, most_pieces: int = 800_000):
        super().__init__()
        self.old: dict[bytes, int] = {}
        self.lower = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        whole = json.loads(tokenizer_json)
        model, steps = whole["model"], whole["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in whole["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
            raise ValueError("only byte-level BPE with word ends, over NFC and lower case, can be compiled")
        self.most_pieces = most_pieces
        self.words = regex.compile(steps[0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in whole["added_tokens"]) or "(?!)")
        self.marks = tuple(x["content"][0].encode() for x in whole["added_tokens"])
        self.transducer = WordTransducer(model)

    def __missing__(self, piece: bytes) -> int:
        if 2 * len(self) > self.most_pieces:
            self.old = dict(self)
            self.clear()
        held = self.old.get(piece)
        if held is not None:
            self[piece] = held
            return held
        text, total = piece.decode("utf-8", "replace"), 0
        parts = [text]
        if any(m in piece for m in self.marks):
            parts = self.special.split(text)
            total = len(parts) - 1
        count = self.transducer.count
        for part in parts:
            part = part.lower() if part.isascii() else self.lower(part)
            for word in self.words.findall(part):
                total += count(word.encode())
        if len(piece) < 256:
            self[piece] = total
        return total

    def text(self, text: bytes) -> int:
        return sum(map(self.__getitem__, text.split()))


_compiled: dict[int, PieceCounter] = {}


def _counter(tokenizer_json: str) -> PieceCounter:
    key = hash(tokenizer_json)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = PieceCounter(tokenizer_json)
    return _compiled[key]


WHITE = regex.compile(rb"[\x20\x09-\x0D]")


def state_map(counter: PieceCounter, chunk: bytes) -> tuple[bytes, int, bytes | None]:
    """(piece at entry, count of what lies between, piece at exit or None if the chunk has no white space)."""
    first = WHITE.search(chunk)
    if first is None:
        return chunk, 0, None
    last = len(chunk) - 1
    while chunk[last] not in b" \t\n\r\x0b\x0c":
        last -= 1
    return chunk[: first.start()], counter.text(chunk[first.start() : last + 1]), chunk[last + 1 :]


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def _mapped(shared, names: list[str], read: Callable[[PieceCounter, bytes], tuple], kinds: list[tuple[str, pa.DataType]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in slices(batches, "text", 16 << 20):
            found = list(zip(*(read(counter, x) for x in _bytes(batch.column("text"))), strict=True)) or [()] * len(kinds)
            arrays = [pa.array(list(x), kind) for x, (_, kind) in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *arrays], names=[*names, *(k for k, _ in kinds)])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk_chars: int = 65_536) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    tokenizer_path: a file of the driver; its text (a few MB, whatever the input) is broadcast.
    chunk_chars: longer texts are cut into chunks of so many characters, which go to different tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    is_long = F.length("text") > chunk_chars
    tokens = ("n_tokens", pa.int64())
    id_type = dict(rows.dtypes)["doc_id"]
    short = rows.filter(~is_long).mapInArrow(_mapped(shared, ["doc_id", "n_bytes"], lambda c, x: (c.text(x),), [tokens]), f"doc_id {id_type}, n_bytes long, n_tokens long")

    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0))
    chunks = rows.filter(is_long).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "n_bytes", F.posexplode(cut).alias("nth", "text")).repartition("row", "nth")
    maps = chunks.mapInArrow(_mapped(shared, ["doc_id", "row", "n_bytes", "nth"], state_map, [("enter", pa.binary()), ("inside", pa.int64()), ("leave", pa.binary())]), f"doc_id {id_type}, row long, n_bytes long, nth int, enter binary, inside long, leave binary")
    # meeting k of a text: what leaves its k-th chunk with white space, chunks without any, what enters the next such chunk
    before = F.coalesce(F.sum(F.col("leave").isNotNull().cast("long")).over(Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    none = F.lit(None).cast("binary")
    pieces = maps.withColumn("meeting", before).select(
        "doc_id", "row", "n_bytes", F.inline(F.array(
            F.struct(F.col("meeting"), (F.col("nth") * 2).alias("at"), F.col("enter").alias("piece"), F.col("inside")),
            F.struct((F.col("meeting") + 1).alias("meeting"), (F.col("nth") * 2 + 1).alias("at"), F.coalesce("leave", none).alias("piece"), F.lit(0).cast("long").alias("inside")),
        ))
    )
    joined = pieces.groupBy("row", "meeting").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("inside").alias("inside"), F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")))).alias("met"))
    text = F.aggregate("met", F.lit(b"").cast("binary"), lambda held, x: F.concat(held, x["piece"]))
    met = joined.select("doc_id", "row", "n_bytes", "inside", text.alias("text"))
    counted = met.mapInArrow(_mapped(shared, ["doc_id", "row", "n_bytes", "inside"], lambda c, x: (c.text(x),), [tokens]), f"doc_id {id_type}, row long, n_bytes long, inside long, n_tokens long")
    long = counted.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum(F.col("inside") + F.col("n_tokens")).alias("n_tokens")).select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
