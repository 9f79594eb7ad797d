"""Texts cut where no token can cross, and the bounded head of a counted table."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.rows import ship

MARK = "▁"
BETWEEN = re.compile(rf"(?<=[^\s{MARK}]) ")
BLANK_BEFORE = re.compile(rf" (?<=[\s{MARK}] )")  # its literal start makes this search far cheaper than the cut above
LEARNT = 20_000  # chunks that go to a tokenizer in one call
GROUP_CHARS = 1_000_000  # texts taken together, so that their new chunks go to a tokenizer in one call


def chunks(text: str) -> list[str]:
    """The text cut at each space behind a character that is no blank.

    Each chunk stands for a space and itself, the first one for the space that is put before a
    text. A chunk may hold further blanks, where a blank follows a blank. An empty text is one
    empty chunk: that space alone.
    """
    if text[:1] == " " or BLANK_BEFORE.search(text):
        return BETWEEN.split(text)
    return text.split(" ")


def pieces_of(model_file: str) -> sentencepiece.SentencePieceProcessor:
    """The piece model, if a piece never goes on over a whitespace mark and texts come back as they were."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if re.search(rf"[^{MARK}]{MARK}", p)]
    probe = " a  Béﬁ\n c "
    if crossing or model.decode(model.encode(probe)) != probe or model.encode("x")[:1] != model.encode("x y")[:1]:
        raise ValueError("texts of this model cannot be cut at spaces")
    return model


def piece_ids(model: sentencepiece.SentencePieceProcessor, cut: list[str]) -> list[list[int]]:
    """Ids of each of these distinct chunks; the model's own leading mark is the chunk's space."""
    ids = model.encode(cut, num_threads=1)
    if "" in cut:
        ids[cut.index("")] = [model.piece_to_id(MARK)]
    return ids


def grouped(texts: Iterable[str], chars: int = GROUP_CHARS) -> Iterator[list[list[str]]]:
    """Chunk lists of consecutive texts, some ``chars`` characters at a time; a longer text comes alone."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > chars:
            yield group
            group, size = [], 0
        group.append(chunks(text))
        size += len(text)
    if group:
        yield group


class Table(dict):
    """What is known of each chunk: a fixed part and up to ``limit`` chunks learnt in this task."""

    def __init__(self, fixed: dict, limit: int):
        super().__init__(fixed)
        self.fixed, self.limit = fixed, limit + len(fixed)

    def learn(self, group: list[list[str]], make) -> None:
        """Chunks of the group that are not known, each once, go through ``make``."""
        if len(self) > self.limit:
            self.clear()
            self.update(self.fixed)
        new = list(set().union(*group).difference(self))
        for at in range(0, len(new), LEARNT):  # what a tokenizer returns is far larger than what is kept of it
            part = new[at : at + LEARNT]
            self.update(zip(part, make(part)))


def head(table: DataFrame, count: str, limit: int) -> DataFrame:
    """Rows with the largest counts, at most ``limit`` of them.

    Counts are classed by sixteenths of a doubling; the classes (1,024 at most) are counted, and
    the largest ones that fit together are taken. Ties stay together, so fewer rows may come.
    """
    size = F.floor(F.log2(count) * 16).cast("int")
    classes = sorted(table.where(F.col(count) > 0).groupBy(size.alias("size")).count().collect(), reverse=True)
    total, least = 0, None
    for row in classes:
        total += row["count"]
        if total > limit:
            break
        least = row["size"]
    return table.where(size >= least if least is not None else F.lit(False))


def int_lists(parts: list[bytes], dtype=np.int32) -> pa.ListArray:
    """A list column of the numbers in each part."""
    width = np.dtype(dtype).itemsize
    ends = np.concatenate([[0], np.cumsum([len(p) // width for p in parts], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), dtype)))


ship(__name__)
