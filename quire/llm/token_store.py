"""Content-addressed store of token ids.

Each document's ids are cut where a rolling hash of the last ``WINDOW`` ids has its low
bits clear, so equal passages give equal chunks wherever they stand.  The store is a
folder of three Parquet tables:

* ``objects``  - one row per object.  A chunk (kind 'c') is stored once: its key is the
  SHA-256 of its little-endian 32-bit ids; ``body`` holds them at ``width`` bytes each.
* ``recipes``  - one row per document in ascending id order (files and rows): its chunk
  keys, where it starts in the id stream, its length, and the Merkle root of its keys.
* ``manifest`` - one row per range of documents: the Merkle root of their roots.

Reading checks every chunk against its key and every recipe against its root.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import bucket_of, fresh_path, order_buckets, order_key, running_total, worker_state

WINDOW = 16
#: A cut has this many low bits of the rolling hash clear: chunks of about 512 ids.
CUT_BITS = 9
MIN_CHUNK, MAX_CHUNK = 128, 4096
#: Distinct words and pieces of words whose ids a worker remembers, up to twice so many.
CACHE_WORDS = 300_000
#: Texts of about so many bytes are encoded together.
SLICE_BYTES = 1 << 22

OBJECTS = "kind string, key binary, width int, n long, body binary, doc_id long, seq long, keys array<binary>, sizes array<int>, root binary"


#: What ``WordTokenizer`` can take apart: the file's normalizer and pre-tokenizer.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordTokenizer:
    """Ids of texts by the tokenizers library, word by word.

    A tokenizer that composes, lower-cases and splits at white space before its merges
    (``BY_WORD``) gives a text the ids of its words in turn.  Words of plain letters,
    digits and ASCII marks go straight to the library's merge model, and each distinct word
    of some texts once; all others, texts with characters that not all take for white
    space, and all texts of other tokenizers go through the whole tokenizer.
    """

    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    OTHER_SPACE = r"[\x1C-\x1F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.by_word = all(made.get(k) == v for k, v in BY_WORD.items()) and not made.get("truncation") and not made.get("padding")
        self.model = self.whole.model
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        #: ids of the latest words and pieces, as a piece has the same ids as a word of its own;
        #: the older half is dropped when both are full
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.byte_char)
            got = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        self.known[piece] = got
        return got

    def _word(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is not None:
            self.known[word] = got
            return got
        get, low = self.known.get, word.lower()
        if len(word) < 256 and (word.isascii() and word.isprintable() or self.PLAIN.fullmatch(word)):
            if low.isalpha():
                got = get(low) or self._piece(low)
            else:
                got = b"".join([get(p) or self._piece(p) for p in self.PIECES.findall(low)])
        else:
            got = self.encode_whole(word) if word else b""
        if len(word) <= 64:
            self.known[word] = got
        return got

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text; a null one has none."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            yield from (self.encode_whole(t) for t in texts.to_pylist())
            return
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        odd = pc.match_substring_regex(texts, self.OTHER_SPACE)
        split = pc.ascii_split_whitespace(pc.if_else(odd, "", texts))
        ends, coded = split.offsets.to_numpy() - split.offsets[0].as_py(), split.flatten().dictionary_encode()
        get, learn = self.known.get, self._word
        known = [get(w) or learn(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)]
        all_ids, code = np.frombuffer(b"".join(known), "<u4"), coded.indices.to_numpy()
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin, each = (np.cumsum(size) - size)[code], size[code]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = all_ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], each)]
        cut = total[ends]
        for k, whole in enumerate(odd.to_pylist()):
            yield self.encode_whole(texts[k].as_py()) if whole else ids[cut[k] : cut[k + 1]].tobytes()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))


def tokenizer(path: str) -> WordTokenizer:
    state = worker_state("words")
    if path not in state:
        state.clear()
        state[path] = WordTokenizer(path)
    return state[path]


_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream (none for an empty one)."""
    n = len(ids)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(29)
    span = 1
    while span < WINDOW:  # the hash of the last 2, 4, ... WINDOW ids, at each id
        h[span:] = h[span:] + h[:-span] * np.uint64(pow(_BASE, span, 1 << 64))
        span *= 2
    h ^= h >> np.uint64(32)
    marks = np.flatnonzero((h & np.uint64((1 << CUT_BITS) - 1)) == 0) + 1
    out, start = [], 0
    while n - start > MIN_CHUNK:
        i = np.searchsorted(marks, start + MIN_CHUNK)
        end = min(int(marks[i]) if i < len(marks) else n, start + MAX_CHUNK, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; leaf and node hashes are told apart by a prefix, and a
    node without a sibling rises as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    if not level:
        return hashlib.sha256(b"").digest()
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def crc32_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC-32 contributes to that of a text in which so many bytes follow: the
    CRC of a concatenation is the exclusive or of the shifted CRCs of its parts."""
    poly, high = np.uint32(0xEDB88320), np.uint32(1 << 31)

    def times(a, b):  # product of polynomials modulo the CRC's, bit-reversed
        out, a, b = np.zeros_like(a), a.copy(), b.copy()
        for k in range(31, -1, -1):
            out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
            b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ poly, b >> np.uint32(1))
        return out

    crc, n = np.asarray(crc, np.uint32), np.asarray(n_bytes, np.uint64)
    power = np.full(1, high >> np.uint32(8), np.uint32)  # x to the 8: one byte
    left = int(n.max()) if len(n) else 0
    bit = 0
    while left >> bit:
        on = (n >> np.uint64(bit) & np.uint64(1)).astype(bool)
        crc[on] = times(np.broadcast_to(power, int(on.sum())).copy(), crc[on])
        power = times(power, power)
        bit += 1
    return crc


def _text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive texts of about a slice's bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def _objects(path: str, end_id: int):
    """Rows of both kinds for batches of (id, seq, text)."""
    schema = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("width", pa.int32()), ("n", pa.int64()), ("body", pa.binary()), ("doc_id", pa.int64()), ("seq", pa.int64()), ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("root", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seen = tokenizer(path), set()  # seen: keys that this task has given out
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, size = [], 0
            texts = (raw + end for part in _text_slices(batch[2]) for raw in tok.encode_all(part))
            for doc_id, seq, raw in zip(batch[0].to_pylist(), batch[1].to_pylist(), texts, strict=True):
                ids = np.frombuffer(raw, "<u4")
                keys, sizes, start = [], [], 0
                for stop in cuts(ids):
                    part = raw[4 * start : 4 * stop]
                    keys.append(key := hashlib.sha256(part).digest())
                    sizes.append(stop - start)
                    if key not in seen:
                        seen.add(key)
                        width = 2 if ids[start:stop].max() < 1 << 16 else 4
                        body = part if width == 4 else ids[start:stop].astype("<u2").tobytes()
                        rows.append(("c", key, width, stop - start, body, None, None, None, None, None))
                        size += len(body)
                    start = stop
                rows.append(("r", None, None, len(ids), None, doc_id, seq, keys, sizes, merkle_root(keys)))
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _first_of_each_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops chunks that this partition, which has all rows of its keys, has had before.
    It remembers 32 bytes for each unique chunk of one partition."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for key in batch.column("key").to_pylist():
            keep.append(key is None or key not in seen)
            if key is not None:
                seen.add(key)
        yield batch.filter(pa.array(keep))


def write_store(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text and writes a store to ``path``.

    A null text counts as empty and holds ``end_id`` alone.  Null ids come first, and rows
    of equal id stand in a fixed order of their contents (equal rows are told apart by a
    number of their own); other columns are ignored; an empty table makes an empty store.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("seq"), F.col(text_col).alias("text"))
    objects = rows.mapInArrow(_objects(tokenizer_path, end_id), OBJECTS)
    dealt = objects.repartition(F.xxhash64(F.coalesce("key", F.col("seq").cast("string").cast("binary"))))
    dealt.mapInArrow(_first_of_each_key, OBJECTS).write.option("compression", "zstd").parquet(f"{path}/objects")
    spark = docs.sparkSession
    recipes = spark.read.schema(OBJECTS).parquet(f"{path}/objects").filter("kind = 'r'").select("doc_id", "seq", "n", "keys", "sizes", "root")
    key = order_key("doc_id", F.xxhash64("root"))
    recipes = recipes.withColumn("key", key).withColumn("bucket", bucket_of(F.col("key"), order_buckets(recipes, key)))
    recipes = running_total(recipes, [], "bucket", ["key"], "n", "start")
    recipes = recipes.select("bucket", "doc_id", "start", F.col("n").alias("n_tokens"), "keys", "sizes", "root")
    order = ["bucket", "start"]
    recipes.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/recipes")

    @F.pandas_udf("binary")
    def root_of(roots: pd.Series) -> pd.Series:
        return pd.Series([merkle_root([bytes(r) for r in x]) for x in roots])

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "root"))), lambda x: x["root"])
    made = spark.read.parquet(f"{path}/recipes").groupBy("bucket").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), ordered.alias("roots"))
    made.select("bucket", "n_docs", "n_tokens", root_of("roots").alias("root")).write.parquet(f"{path}/manifest")


def _checked(rows: pd.DataFrame) -> pd.DataFrame:
    crcs = []
    for key, width, body in zip(rows["key"], rows["width"], rows["body"], strict=True):
        ids = np.frombuffer(body, "<u2" if width == 2 else "<u4").astype("<u4").tobytes()
        if hashlib.sha256(ids).digest() != bytes(key):
            raise ValueError(f"chunk {bytes(key).hex()} doesn't match its key")
        crcs.append(zlib.crc32(ids))
    return pd.DataFrame({"key": rows["key"], "size": rows["n"], "crc": np.array(crcs, np.int64)})


def _check_root(keys: list[bytes], root: bytes) -> None:
    if merkle_root(keys) != bytes(root):
        raise ValueError("a recipe doesn't match its root")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes whose chunk keys match their Merkle root; any other raises."""

    @F.pandas_udf("boolean")
    def sound(keys: pd.Series, roots: pd.Series) -> pd.Series:
        for k, r in zip(keys, roots, strict=True):
            _check_root([bytes(x) for x in k], r)
        return pd.Series([True] * len(keys))

    return spark.read.parquet(f"{path}/recipes").filter(sound("keys", "root"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks) of every document, from the files.

    Each stored chunk is read and checked once; a document's CRC-32 is put together from
    those of its chunks, so no ids are shuffled.  Recipes are checked as by ``read_recipes``,
    but where their parts are made: one worker a task, keys sent to it once.
    """
    chunks = spark.read.schema(OBJECTS).parquet(f"{path}/objects").filter("kind = 'c'").select("key", "width", "n", "body")
    chunks = chunks.mapInPandas(lambda it: map(_checked, it), "key binary, size long, crc long")

    @F.pandas_udf("array<struct<key: binary, here: long, after: long>>")
    def parts_of(keys: pd.Series, sizes: pd.Series, roots: pd.Series) -> pd.Series:
        out = []
        for k, n, root in zip(keys, sizes, roots, strict=True):
            k, n = [bytes(x) for x in k], np.asarray(n, np.int64)
            _check_root(k, root)
            out.append([{"key": x, "here": h, "after": a} for x, h, a in zip(k, n.tolist(), (4 * (n.sum() - n.cumsum())).tolist(), strict=True)])
        return pd.Series(out)

    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("doc_id", "start", "n_tokens", F.explode(parts_of("keys", "sizes", "root")).alias("p")).select("doc_id", "start", "n_tokens", "p.*")

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, n_bytes: pd.Series) -> pd.Series:
        return pd.Series(crc32_shift(crc.to_numpy(np.uint32), n_bytes.to_numpy(np.uint64)).astype(np.int64))

    joined = parts.join(chunks, "key", "left").select("doc_id", "start", "n_tokens", F.when(F.col("size") == F.col("here"), F.col("size")).alias("size"), shifted(F.coalesce("crc", F.lit(0)), "after").alias("crc"))
    whole = joined.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"), F.count("*").alias("n_chunks"), F.sum("size").alias("_found"), F.count("size").alias("_sized"))
    sound = (F.col("_found") == F.col("n_tokens")) & (F.col("_sized") == F.col("n_chunks"))
    return whole.select("doc_id", "start", "n_tokens", F.when(sound, F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a chunk is missing")).cast("long")).alias("ids_crc32"), "n_chunks")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<long>): every document put together from its chunks."""
    chunks = spark.read.schema(OBJECTS).parquet(f"{path}/objects").filter("kind = 'c'").select("key", "width", "body")
    parts = read_recipes(spark, path).select("doc_id", "start", F.posexplode("keys").alias("at", "key"))

    @F.pandas_udf("array<long>")
    def ids_of(widths: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([np.frombuffer(b, "<u2" if w == 2 else "<u4").astype(np.int64) for w, b in zip(ws, bs, strict=True)]) for ws, bs in zip(widths, bodies, strict=True)])

    whole = parts.join(chunks, "key").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("at", "width", "body"))).alias("p"))
    return whole.select("doc_id", "start", ids_of("p.width", "p.body").alias("ids"))


def store_and_read_back(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes a store of ``docs`` to the shared folder and returns what it reads back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-store")
    write_store(docs, tokenizer_path, path, end_id)
    return read_digests(spark, path)
