"""Best-two-fit packing of documents into sequences of at most ``size`` tokens.

Documents are tokenised where they are read; only (id, piece, length) travels. Pieces are dealt at random
into groups of about ``GROUP`` and each group is packed by itself:

* fill: a new sequence takes the longest piece left, then again and again the longest that fits its gap;
* two for one: if a gap remains, the sequence's shortest piece is taken out if two pieces left over fill the
  widened gap better; the best pair is the one with the largest sum that fits.

A group of thousands of pieces leaves at most one poorly filled sequence, whatever the corpus's size, and no
task holds more than a group. A sequence is (group, number in the group), joined into one long.

Defined cases: null or empty text is the end token alone; a piece of exactly ``size`` tokens is a sequence;
equal rows (also with equal ids) are packed once each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsekit.llm.wordtokens import word_tokenizer

SIZE, END = 4096, 1
GROUP = 8192


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END, doc_id: str = "doc_id",
                 text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` tokens: (doc_id, piece, start, length, ids_crc32[, ids])."""
    path = tokenizer or default_tokenizer()

    def cut(batches):
        pack = word_tokenizer(path).pack
        tail = int(end).to_bytes(4, "little")
        for batch in batches:
            out = []
            for d, ids in zip(batch.column(0).to_pylist(), pack([t or "" for t in batch.column(1).to_pylist()])):
                ids += tail
                for n, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at:at + 4 * size]
                    out.append((d, n, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None))
            cols = list(zip(*out)) or [()] * 6
            data = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                data.append(pa.array(cols[5], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(data, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def best_two_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece."""
    order = np.argsort(lengths, kind="stable")
    places: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        places.setdefault(int(lengths[i]), []).append(i)
    left = 0                      # bit n: pieces of length n are left
    for n in places:
        left |= 1 << n

    def longest(most: int) -> int:
        return (left & ((1 << most + 1) - 1)).bit_length() - 1 if most > 0 else -1

    def take(n: int) -> int:
        nonlocal left
        i = places[n].pop()
        if not places[n]:
            left &= ~(1 << n)
        return i

    def best_pair(most: int, over: int) -> tuple[int, int] | None:
        """Two pieces left whose sum is largest, at most ``most`` and more than ``over``."""
        best, a = None, longest(most - 1)
        while a > 0 and 2 * a > over:
            b = longest(min(a, most - a))
            if b == a and len(places[a]) < 2:
                b = longest(a - 1)
            if b > 0 and a + b > over:
                best, over = (a, b), a + b
                if over == most:
                    break
            a = longest(a - 1)
        return best

    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while left:
        n = left.bit_length() - 1
        own = [(n, take(n))]
        gap = size - n
        while (n := longest(gap)) > 0:
            own.append((n, take(n)))
            gap -= n
        if gap > 0 and left:
            small, i = own[-1]
            pair = best_pair(gap + small, small)
            if pair:
                own.pop()
                own += [(n, take(n)) for n in pair]
                places.setdefault(small, []).append(i)
                left |= 1 << small
                gap += small - sum(pair)
                while (n := longest(gap)) > 0:
                    own.append((n, take(n)))
                    gap -= n
        at = 0
        for n, i in own:
            sequence[i], offset[i] = number, at
            at += n
        number += 1
    return sequence, offset


def pack_pieces(pieces: DataFrame, n_pieces: int, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """``pieces`` (a written or checkpointed table: rows are dealt by their place in it) plus (sequence_id, offset)."""
    groups = max(1, -(-n_pieces // group))
    names = [f.name for f in pieces.schema]

    def pack(table: pa.Table) -> pa.Table:
        number = table.column("_group")[0].as_py()
        lengths = table.column("length").to_numpy()
        sequence, offset = best_two_fit(lengths, size)
        return (table.select(names).append_column("sequence_id", pa.array(sequence * groups + number, pa.int64()))
                .append_column("offset", pa.array(offset, pa.int64())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    return pieces.withColumn("_group", number).groupBy("_group").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    from lapsekit.session import cut_lineage
    pieces = cut_lineage(token_pieces(docs, tokenizer, size, end, doc_id, text))  # tokenised once, small rows
    return pack_pieces(pieces, pieces.count(), size)
