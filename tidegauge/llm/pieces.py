"""SentencePiece encoding by Aho-Corasick and Viterbi, and decoding.

The automaton over all pieces reports, for each end position, every piece that
ends there (it follows the output links), so one pass over the text relaxes the
best score of each position. Characters that no piece covers cost ``UNKNOWN``
below the worst piece and become byte pieces.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import on_workers

MODEL = "piece_bpe_32k.model"
UNKNOWN = 10.0
SPACE_MARK = "▁"
_CACHED, _CACHED_CHARS = 300_000, 40


class Pieces:
    """The pieces of a model: text, score and the ids of bytes."""

    def __init__(self, texts: list[str], scores: list[float], kinds: list[str], add_prefix: bool = True):
        import ahocorasick

        self.texts, self.add_prefix = texts, add_prefix
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.bytes = {int(texts[i][3:-1], 16): i for i, k in enumerate(kinds) if k == "byte"}
        self.byte_of = np.full(len(texts) or 1, -1)
        for b, i in self.bytes.items():
            self.byte_of[i] = b
        self.shown = ["" if k == "control" else t for t, k in zip(texts, kinds)]
        self.unknown = next((i for i, k in enumerate(kinds) if k == "unknown"), 0)
        self.unknown_score = min((scores[i] for i in normal if scores[i] > -1e8), default=0.0) - UNKNOWN
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(texts[i], (i, len(texts[i]), scores[i]))
        if normal:
            self.automaton.make_automaton()
        self.empty = not normal
        self.single = {texts[i] for i in normal if len(texts[i]) == 1}
        # Pieces that hold a space mark only in front never cross from a word into the next space.
        self.separable = all(SPACE_MARK not in texts[i].lstrip(SPACE_MARK) for i in normal)
        # A line feed that is in no piece stands alone.
        feed = "" if any("\n" in texts[i] for i in normal) else "\n"
        self.words = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}{feed}]+|{SPACE_MARK}+|\n")
        self._known: dict[str, tuple[bytes, int, float, int]] = {}
        self._older: dict[str, tuple[bytes, int, float, int]] = {}

    def marked(self, text: str) -> str:
        """Spaces as marks, one in front of the text."""
        return (SPACE_MARK if self.add_prefix and text else "") + text.replace(" ", SPACE_MARK)

    def best_path(self, text: str) -> tuple[list[int], float]:
        """Ids of the best segmentation; of equal scores the longest last piece wins."""
        return self._covered_path(text) if self.single.issuperset(text) else self._any_path(text)

    def _covered_path(self, text: str) -> tuple[list[int], float]:
        """Every character is a piece, so every position is reached."""
        n = len(text)
        score, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        for end, piece in self.automaton.iter(text):
            end += 1
            s = score[end - piece[1]] + piece[2]
            if s > score[end]:
                score[end], back[end] = s, piece
        ids, p = [], n
        while p:
            i, length, _ = back[p]
            ids.append(i)
            p -= length
        return ids[::-1], score[n]

    def _any_path(self, text: str) -> tuple[list[int], float]:
        n = len(text)
        score, back = [0.0] + [None] * n, [None] * (n + 1)
        reached = 0  # positions up to here are settled

        def settle(upto: int) -> None:
            """Positions that no piece ends at are reached by an unknown character."""
            for p in range(reached + 1, upto + 1):
                s = score[p - 1] + self.unknown_score
                if score[p] is None or (p not in single and s > score[p]):
                    score[p], back[p] = s, (-1, 1)

        single: set[int] = set()
        for end, (i, length, value) in () if self.empty else self.automaton.iter(text):
            p = end + 1
            if p > reached + 1:
                settle(p - 1)
                reached = p - 1
            s = score[p - length] + value
            if score[p] is None or s > score[p]:
                score[p], back[p] = s, (i, length)
            if length == 1:
                single.add(p)
        settle(n)
        ids, p = [], n
        while p:
            i, length = back[p]
            if i >= 0:
                ids.append(i)
            else:
                raw = text[p - 1].encode("utf-8", "surrogatepass")
                ids += reversed([self.bytes[b] for b in raw]) if all(b in self.bytes for b in raw) else [self.unknown]
            p -= length
        return ids[::-1], score[n]

    def _word(self, word: str) -> tuple[bytes, int, float, int]:
        found = self._older.get(word)
        if found is None:
            ids, score = self.best_path(word)
            n_bytes = 0 if self.single.issuperset(word) else int((self.byte_of[ids] >= 0).sum())
            found = (struct.pack(f"<{len(ids)}I", *ids), len(ids), score, n_bytes)
        if len(word) <= _CACHED_CHARS:
            if len(self._known) >= _CACHED:
                self._known, self._older = {}, self._known
            self._known[word] = found
        return found

    def encode(self, text: str) -> tuple[np.ndarray, float, int]:
        """Ids, total score and number of byte pieces of a whole text."""
        marked = self.marked(text)
        words = self.words.findall(marked) if self.separable else [marked] * bool(marked)
        found = [self._known.get(w) or self._word(w) for w in words]
        return (np.frombuffer(b"".join([f[0] for f in found]), "<u4"), float(sum([f[2] for f in found])),
                sum([f[3] for f in found]))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, bytes put together, marks as spaces, the first space dropped."""
        values, shown = self.byte_of[ids], self.shown
        at = np.flatnonzero(values >= 0)
        plain, out, done = list(map(shown.__getitem__, ids.tolist())), [], 0
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
            first, last = int(run[0]), int(run[-1]) + 1
            out += plain[done:first]
            out.append(bytes(values[first:last].tolist()).decode("utf-8", "replace"))
            done = last
        text = "".join(out + plain[done:]).replace(SPACE_MARK, " ")
        return text[1:] if self.add_prefix and text[:1] == " " else text


def read_model(path: str) -> tuple[list[str], list[float], list[str]]:
    """Texts, scores and kinds of the pieces of a model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)

    def kind(i: int) -> str:
        return ("byte" if model.is_byte(i) else "control" if model.is_control(i) else "unknown" if model.is_unknown(i)
                else "unused" if model.is_unused(i) else "normal")

    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], [kind(i) for i in ids]


_built: dict = {}


def pieces_of(shared) -> Pieces:
    """One automaton per worker process and broadcast."""
    if shared not in _built:
        _built.clear()
        _built[shared] = Pieces(*shared.value)
    return _built[shared]


def encode_documents(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Columns: ``doc_id``, ``n_tokens``, ``ids_crc32`` (of little-endian 32-bit
    ids), ``n_bytes`` (byte pieces), ``score``, ``round_trip`` (the decoded text
    equals the text) and, if asked, ``ids``. A null or empty text has no ids and
    round-trips; a text that holds the space mark itself decodes to a space.
    Repeated rows and null keys are encoded like others; extra columns are not
    read; an empty table gives an empty one. The model is read on the driver and
    broadcast; its size does not depend on the data.
    """
    spark = on_workers(docs.sparkSession)
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)
    shared = spark.sparkContext.broadcast(read_model(model))

    def run(batches):
        pieces = pieces_of(shared)
        for b in batches:
            rows = []
            for k, t in zip(b["doc_id"], b["text"]):
                t = t or ""
                ids, score, n_bytes = pieces.encode(t)
                row = (k, len(ids), zlib.crc32(ids.tobytes()), n_bytes, score, pieces.decode(ids) == t)
                rows.append((*row, ids.astype(np.int64)) if with_ids else row)
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "n_tokens", "ids_crc32", "n_bytes", "score", "round_trip"] + ["ids"] * with_ids
    schema = ("doc_id string, n_tokens long, ids_crc32 long, n_bytes long, score double, round_trip boolean"
              + ", ids array<long>" * with_ids)
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema[key].dataType))
