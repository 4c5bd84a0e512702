"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of the model has a marker (U+2581) after another character, no
merge can cross the start of a marker run. A text is then the concatenation of
chunks - a run of markers and what follows up to the next run - and each
distinct chunk is segmented once; the ids of a text are the table's ids joined
by position. Decoding works on the same table: the surface of a text is the
surfaces of its chunks, joined by the blank that each further marker stands
for. The table lives in the task that reads the texts, so nothing is shuffled
and no vocabulary is broadcast; it starts anew beyond `TABLE_CHUNKS` entries or
`TABLE_CHARS` characters, and chunks over `LONG` characters, as texts without
blanks have them, are segmented where they occur and not kept.
A model for which the rule does not hold is applied to whole texts.

Edge cases: a null text counts as empty; an empty text has no ids and decodes
to an empty text; repeated rows give repeated results; other columns of the
input are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelarium.llm.common import read_table, text_slices

TABLE_CHUNKS = 1 << 20
#: Characters of chunks and ids that a table has at most, but for one slice of texts; of a chunk that it keeps.
TABLE_CHARS, LONG = 64 << 20, 256
MODEL = "piece_bpe_32k.model"
_MARK = "▁"
_RUN = re.compile(r" +[^ ]*")
_TYPES = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver; it is half a megabyte and goes along with the task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


def chunks_are_independent(sp: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether no piece crosses into a marker run and blanks are kept one for one behind one added marker."""
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    if any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces):
        return False
    return all(sp.decode(sp.encode(t)) == t for t in (" a", "a  b ", "  ", "ﬁ Å", "a\tb\nc"))


def split_chunks(text: str) -> list[str]:
    """Chunks of a text that is not empty, each without the marker that the library adds or that joins it on."""
    text = text.replace(_MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [c[1:] for c in _RUN.findall(" " + text)]
    return text.split(" ")


class ChunkCodec:
    """Segments texts by the table of distinct chunks."""

    def __init__(self, model: bytes, table_chunks: int = TABLE_CHUNKS, *, decode: bool = True, table_chars: int = TABLE_CHARS):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunked = chunks_are_independent(self.sp)
        self.decodes = decode
        self.most, self.most_chars, self.chars = table_chunks, table_chars, 0
        self.ids: dict[str, str] = {}  # chunk -> its ids in decimal, joined by commas
        self.odd: dict[str, str] = {}  # chunk -> what its ids decode to, where that isn't the chunk itself
        self.blank = ",".join(map(str, self.sp.encode("a ")[len(self.sp.encode("a")) :]))  # one marker with nothing behind it

    def _segment(self, chunks: list[str]) -> tuple[list[str], dict[str, str]]:
        """The ids of chunks that are not empty, and what they decode to where that isn't the chunk itself."""
        ids = self.sp.encode(chunks, num_threads=1) if chunks else []
        odd = {c: d for c, d in zip(chunks, self.sp.decode(ids, num_threads=1), strict=True) if c != d} if ids and self.decodes else {}
        return [str(x)[1:-1].replace(" ", "") for x in ids], odd

    def _add(self, chunks: Iterable[str]) -> None:
        new = [c for c in chunks if c and len(c) <= LONG]
        ids, odd = self._segment(new)
        self.ids.update(zip(new, ids, strict=True))
        self.odd.update(odd)
        self.ids[""] = self.blank
        self.chars += sum(map(len, new)) + sum(map(len, ids))

    def learn(self, texts: Iterable[str | None]) -> None:
        """Segment in one call every chunk of the texts that the table lacks."""
        if not self.chunked:
            return
        if len(self.ids) > self.most or self.chars > self.most_chars:
            self.ids.clear()
            self.odd.clear()
            self.chars = 0
        missing: set[str] = set()
        for text in texts:
            if text:
                missing.update(split_chunks(text))
        self._add(missing.difference(self.ids))

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal joined by commas, and what they decode to (nothing where the codec doesn't decode)."""
        if not text:
            return 0, "", ""
        if not self.chunked:
            ids = self.sp.encode(text)
            return len(ids), ",".join(map(str, ids)), self.sp.decode(ids) if self.decodes else ""
        chunks, odd = split_chunks(text), self.odd
        try:
            ids = ",".join(map(self.ids.__getitem__, chunks))
        except KeyError:
            self._add(set(chunks).difference(self.ids))
            long = list({c for c in chunks if len(c) > LONG})
            found, more = self._segment(long)
            own, odd = dict(zip(long, found, strict=True)), {**self.odd, **more} if more else self.odd
            ids = ",".join(own[c] if len(c) > LONG else self.ids[c] for c in chunks)
        if not self.decodes:
            return ids.count(",") + 1, ids, ""
        return ids.count(",") + 1, ids, " ".join([odd.get(c, c) for c in chunks] if odd else chunks)


def _worker(model: bytes, outputs: tuple[str, ...], chunks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(model, chunks, decode=any(name.startswith("decoded") for name in outputs))
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        make = {
            "n_tokens": (pa.int64(), lambda n, ids, dec: n),
            "ids": (pa.list_(pa.int32()), lambda n, ids, dec: [int(x) for x in ids.split(",")] if ids else []),
            "decoded": (pa.string(), lambda n, ids, dec: dec),
            "ids_sha256": (pa.string(), lambda n, ids, dec: sha(ids)),
            "decoded_sha256": (pa.string(), lambda n, ids, dec: sha(dec)),
        }
        for batch in batches:
            for part in text_slices(batch, 1):
                texts = part.column(1).to_pylist()
                codec.learn(texts)
                values: list[list] = [[] for _ in outputs]
                for text in texts:
                    got = codec.encode(text)
                    for column, name in zip(values, outputs, strict=True):
                        column.append(make[name][1](*got))
                columns = [pa.array(v, make[name][0]) for v, name in zip(values, outputs, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *outputs])

    return run


def encode_decode(docs: DataFrame, outputs: Iterable[str] = ("n_tokens", "ids", "decoded"), *, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, table_chunks: int = TABLE_CHUNKS) -> DataFrame:
    """Each row's id as `doc_id` and the asked-for `outputs`: n_tokens, ids, decoded and their sha256 digests."""
    outputs = tuple(outputs)
    schema = ", ".join(["doc_id long", *(f"{name} {_TYPES[name]}" for name in outputs)])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_worker(model_bytes(model_path), outputs, table_chunks), schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_decode(read_table(spark, sf_dir, "documents"), ("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
SQL: dict[str, str] = {}
