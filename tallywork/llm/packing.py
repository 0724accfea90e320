"""Token sequences of bounded length with next to no padding: hierarchical multi-length packing.

Each task reads its documents in order and packs them on its own, so no text is shuffled and a lost executor costs only
its own tasks. Documents are routed by length to tiers with contexts of their own (an eighth, a quarter, a half and the
whole of the longest window); one of a full window's length or more fills windows of its own and only its rest is routed.
Each tier is packed into windows of its context: its longest documents first, their gaps filled from shorter tiers, the
last cut to fit. What remains at the end of a task goes to windows of smaller powers of two, which need no padding. All
windows are then dealt to step groups of the same number of tokens, each with its share of long and short windows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from ..session import store
from .common import named

END_ID = 2
PIECES = ("doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "window long, nth long")
#: Contexts of the tiers: the window and its halves.
TIERS = 4


class WordIds(dict):
    """Token ids, as little-endian bytes, of pieces of text between white space, each made once a task.

    The tokenizer never joins text over white space, so the ids of a text are those of its pieces in turn. Nor does it
    join a run of letters with the signs after it, so most pieces share their parts: letters go straight to the model,
    in lower case and in its byte alphabet, and anything but plain letters and signs takes the whole tokenizer. A
    vocabulary of another kind (cased, or with blanks in its words) shows on the probes, and whole texts are encoded."""

    def __init__(self, vocabulary: str, most: int = 400_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        self.tokenizer, self.most = Tokenizer.from_str(vocabulary), most
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): alphabet.pre_tokenize_str(c)[0][0] for c in _LETTERS.lower()}
        self.by_pieces = all(self._of_pieces(t) == self._of_whole(t) for t in _PROBES)

    def of(self, text: str | None) -> bytes:
        return self._of_pieces(text or "") if self.by_pieces else self._of_whole(text or "")

    def _of_whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _of_pieces(self, text: str) -> bytes:
        if len(self) > self.most:  # forgets what it can make again
            self.clear()
            self.parts.clear()
        words = text.split() if not _SEPARATORS.search(text) else _SPACES.split(text)
        return b"".join(map(self.__getitem__, words))

    def __missing__(self, piece: str) -> bytes:
        plain = _PLAIN.fullmatch(piece)
        if not plain:
            made = self._of_whole(piece)
        else:
            word, signs = plain[1].lower(), plain[2]
            made = self.parts.get(word)
            if made is None:
                made = self.parts[word] = _packed([t.id for t in self.model.tokenize(word.translate(self.letters))])
            if signs:
                tail = self.parts.get(signs)
                if tail is None:
                    tail = self.parts[signs] = self._of_whole(signs)
                made += tail
        self[piece] = made
        return made


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: Letters that are one letter in lower case and are never composed with others. Signs: ASCII ones but the apostrophe.
_LETTERS = "".join(chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xDF, 0xF7, 0xFF))
_PLAIN = re.compile(f"([{_LETTERS}]+)([!-&(-/:-@\\[-`{{-~]*)")
#: Characters that Python takes for white space and the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: Texts that tell a vocabulary in lower case whose words end at white space from any other.
_PROBES = ("The Cat sat  on A mat,\nit's 42!", "lower case words only", "UPPER Case Words", f" {_LETTERS} ", "a\tb  c\r\nd ", "naïve Étude (x) [y] -- 3.14")


@dataclass
class Waiting:
    """What of a document is not packed yet: its ids from `start` on."""

    doc_id: str | None
    ids: memoryview
    start: int
    tokens: int

    def left(self) -> int:
        return len(self.ids) // 4


@dataclass
class Packer:
    """Packs one task's documents. Holds about `hold` windows of each tier at any time."""

    window: int
    first_id: int
    hold: int = 64
    #: What waits, by the power of two that its length does not exceed; the tiers above the shortest are one queue each.
    queues: list[deque] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)
    made: int = 0
    made_of: dict[int, int] = field(default_factory=dict)
    rows: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        if self.window < 1 or self.window & (self.window - 1):
            raise ValueError(f"a window is a power of two, not {self.window}")
        self.queues = [deque() for _ in range(self.window.bit_length())]
        self.tokens = [0] * len(self.queues)
        top = len(self.queues) - 1
        self.lowest = max(top - TIERS + 1, 0)

    def add(self, doc_id: str | None, ids: bytes) -> None:
        rest = Waiting(doc_id, memoryview(ids), 0, len(ids) // 4)
        while rest.left() >= self.window:
            self._fill([rest], self.window)
        if rest.left():
            self._wait(rest)
        self._pack_tiers(self.hold)

    def finish(self) -> None:
        self._pack_tiers(1)
        while waiting := sum(self.tokens):
            size = self.window
            while size > waiting:
                size //= 2
            self._pack(size, len(self.queues) - 1)

    def _pack_tiers(self, hold: int) -> None:
        """Packs each tier, the longest first, until less than `hold` windows wait in it."""
        for q in range(len(self.queues) - 1, self.lowest - 1, -1):
            while self._waiting(q) >= hold << q:
                self._pack(1 << q, q)

    def _waiting(self, q: int) -> int:
        return self.tokens[q] if q > self.lowest else sum(self.tokens[: q + 1])

    def _pack(self, size: int, top: int) -> None:
        chosen = self._choose(size, top)
        self._fill(chosen, size)
        if chosen[-1].left():
            self._wait(chosen[-1])

    def _wait(self, doc: Waiting) -> None:
        q = (doc.left() - 1).bit_length()
        self.queues[q].append(doc)
        self.tokens[q] += doc.left()

    def _choose(self, size: int, top: int) -> list[Waiting]:
        """Documents for one window from the queues up to `top`: the longest that fits, again and again, then one to be cut."""
        chosen, free = [], size
        while free:
            q = next((q for q in range(min((free - 1).bit_length(), top), -1, -1) if self.queues[q] and self.queues[q][0].left() <= free), None)
            if q is None:
                q = next(q for q in range(top + 1) if self.queues[q] and self.queues[q][0].left() > free)
            doc = self.queues[q].popleft()
            self.tokens[q] -= doc.left()
            chosen.append(doc)
            free -= min(free, doc.left())
        return chosen

    def _fill(self, docs: list[Waiting], size: int) -> None:
        at, nth = 0, self.made_of.get(size, 0)
        for doc in docs:
            n = min(doc.left(), size - at)
            crc = zlib.crc32(doc.ids[: 4 * n])
            self.rows.append((doc.doc_id, doc.start, n, crc, doc.tokens, self.first_id + self.made, at, size, nth))
            doc.ids, doc.start, at = doc.ids[4 * n :], doc.start + n, at + n
        self.made += 1
        self.made_of[size] = nth + 1


def in_steps(pieces: DataFrame, window: int, steps: int) -> DataFrame:
    """`pieces` with step in place of nth (the number of a window among those of its size and task).

    Windows in the order of their sizes, longest first, fill bundles of `window` tokens without a rest, as all sizes are
    powers of two. Bundles are dealt to the steps in turn, `steps` to each, so every step but the last has the same number
    of tokens and its share of each size. Only counts by task and size meet in one place."""
    task = F.shiftright("sequence_id", 33)
    made = pieces.filter("offset = 0").groupBy(task.alias("task"), F.col("window").alias("size")).count()
    before = Window.orderBy(F.desc("size"), "task").rowsBetween(Window.unboundedPreceding, -1)
    held = F.col("count") * F.col("size")
    made = store(made.select("task", "size", F.coalesce(F.sum(held).over(before), F.lit(0)).alias("before"), held.alias("held")))
    full = (made.agg(F.sum("held")).first()[0] or 0) // window // steps
    bundle = F.floor((F.col("before") + F.col("nth") * F.col("size")) / F.lit(window))
    step = F.when(bundle < full * steps, F.pmod(bundle, F.lit(max(full, 1)))).otherwise(F.lit(full)).cast("long")
    kept = [pieces[c] for c in pieces.columns if c != "nth"]
    return pieces.join(F.broadcast(made), (task == made["task"]) & (pieces["window"] == made["size"])).select(*kept, step.alias("step"))  # a few rows a task


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, steps: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step.

    `tokenizer` is a vocabulary file that the driver can read; its text goes to the tasks. A document is its ids and the
    end id; a null or empty text is the end id alone. `window`, a power of two, is the longest context. Windows are full,
    so none is padded. A step is `steps` longest windows of tokens, over all tasks, in long and short windows alike; only
    the last has fewer. Repeated rows are packed as often as they come, a null id stays null, an empty table gives no rows."""
    vocabulary = Path(tokenizer).read_text(encoding="utf-8")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordIds(vocabulary)
        packer = Packer(window, TaskContext.get().partitionId() << 33)
        end = END_ID.to_bytes(4, "little")
        names = [c.split()[0] for c in PIECES.split(", ")]

        def out() -> pd.DataFrame:
            rows, packer.rows = packer.rows, []
            return pd.DataFrame(rows, columns=names)

        for pdf in batches:
            for key, value in zip(pdf["doc_id"], pdf["text"]):
                packer.add(key, words.of(value) + end)
            if packer.rows:
                yield out()
        packer.finish()
        if packer.rows:
            yield out()

    d = named(docs, doc_id=doc_id, text=text)
    kind = d.schema["doc_id"].dataType.simpleString()
    pieces = d.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, PIECES).withColumn("doc_id", F.col("doc_id").cast(kind))
    # Stored, so that the counts and the rows are of the same packing.
    return in_steps(store(pieces), window, steps)
