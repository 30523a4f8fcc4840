"""What the operators share: staged tables, row keys, words, tokenizer access, hashes of words."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import json
import re
import resource
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as the contracts define them: six ASCII characters, nothing else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_words = re.compile(WORD).findall
#: White space to str.split() that parts no words here.
_INNER = [*map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]


def words_of(text: str) -> list[str]:
    """The words of a text, in order."""
    if any(c in text for c in (_INNER[:4] if text.isascii() else _INNER)):
        return _words(text)
    return text.split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a local one in local mode (tests), an error on a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillet-"))
        found = sc.getCheckpointDir()
    return found


_scopes = {"now": "main", "last": None}


def scratch(spark: SparkSession, name: str, scope: str | None = None) -> str:
    """A new path in the shared folder, in the scope that is open."""
    return f"{shared_dir(spark).rstrip('/')}/quillet-{spark.sparkContext.applicationId}/{scope or _scopes['now']}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is staged within goes when the next scope opens: for steps whose result is written before the next one begins.

    One chain of such steps at a time in an application.
    """
    if _scopes["last"]:
        delete(spark, _scopes["last"])
    before, _scopes["now"] = _scopes["now"], f"scope-{uuid.uuid4().hex[:12]}"
    _scopes["last"] = scratch(spark, "x").rsplit("/", 1)[0]
    try:
        yield
    finally:
        _scopes["now"] = before


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    by: a column of few values; rows of one value lie apart, and readers of one value read no other rows.
    """
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is staged within gives up its shuffle files when it is written, not when the driver's heap is next collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(*staged: DataFrame) -> None:
    """Delete tables that stage() gave, when nothing reads them any more."""
    for df in staged:
        delete(df.sparkSession, df.staged_at)


def cleanup(spark: SparkSession) -> None:
    """Delete the staged tables of this application; results that still read them must be written first."""
    delete(spark, f"{shared_dir(spark).rstrip('/')}/quillet-{spark.sparkContext.applicationId}")


def pin_scans(spark: SparkSession) -> None:
    """Fix what the size of scan partitions depends on, so that later scans of a table get the same partitions even
    when executors were lost or added meanwhile; row keys follow from them."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)


def column_of(df: DataFrame, name: str) -> str | None:
    """The column of df that Spark finds under name (whatever the case, unless spark.sql.caseSensitive), or None."""
    same = (lambda x: x) if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    found = [c for c in df.columns if same(c) == same(name)]
    if len(found) > 1:
        found = [c for c in found if c == name]
    return found[0] if found else None


def keyed(df: DataFrame, optional: tuple[str, ...] = (), **columns: str) -> DataFrame:
    """rid, a key for each row, and the named columns under the operator's own names; other columns go, so they can't clash.

    A column that df hasn't is an error, or null if it is optional. The key follows the scan order, so a recomputed
    partition gets the same keys; feed tables or staged frames, whose row order is fixed.
    """
    places = {k: next((i for i, x in enumerate(df.columns) if x == column_of(df, c)), None) for k, c in columns.items()}
    if missing := [columns[k] for k, i in places.items() if i is None and k not in optional]:
        raise ValueError(f"the table has no column {', '.join(missing)}; it has {', '.join(df.columns)}")
    pin_scans(df.sparkSession)
    df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return df.select(
        F.monotonically_increasing_id().alias("rid"),
        *((F.lit(None).cast("string") if i is None else F.col(f"c{i}")).alias(k) for k, i in places.items()),
    )


def n_words(text: Column) -> Column:
    """How many words a text has; 0 for null. Runs in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array (null: empty) without a copy for each row, and n + 1 offsets."""
    import pyarrow as pa

    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions where words start and end, and the number of words before each row (n + 1); words don't cross rows."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    start[cut] = inside[cut]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cut = cut[cut > 0] - 1
    end[cut] = inside[cut]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


_POWER = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: The lowest n bytes of a 64-bit number, n from 0 to 8.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finaliser: a bijection that spreads the bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each word: the bytes and length of one of up to 15 bytes, the 128-bit xxh3 of a longer one."""
    import xxhash

    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
    n = ends - starts
    low = eight[starts] & _BYTES[np.minimum(n, 8)]
    high = eight[starts + 8] & _BYTES[np.clip(n - 8, 0, 7)] | np.minimum(n, 15).astype(np.uint64) << np.uint64(56)
    raw = padded.data
    for i in np.flatnonzero(n > 15).tolist():
        d = xxhash.xxh3_128_intdigest(raw[starts[i] : ends[i]])
        low[i], high[i] = d & 0xFFFFFFFFFFFFFFFF, d >> 64
    return low, high


def word_halves(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word's bytes, together a 128-bit one.

    They are a bijection of the word's numbers: two words of up to 15 bytes never agree in both. Longer words are
    first digested by a hash which is no algebraic sum of the bytes.
    """
    low, high = word_numbers(data, starts, ends)
    first = mix(low ^ mix(high + np.uint64(_POWER[0])))
    return first, mix(high ^ mix(first + np.uint64(_POWER[1])))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the first of word_halves."""
    low, high = word_numbers(data, starts, ends)
    return mix(low ^ mix(high + np.uint64(_POWER[0])))


def window_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes; windows that cross rows are the caller's to leave out."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    odd, done, out, width = np.uint64(_POWER[which] | 1), 1, words.copy(), 1
    # doubling: a window of 2n words is two of n; k is then put together from the powers of two in it
    parts, at = [], 0
    level = words
    while True:
        if k & width:
            parts.append((level, at, width))
            at += width
        width *= 2
        if width > k:
            break
        half = width // 2
        level = mix(level[: len(level) - half] * odd + level[half:])
    n = len(words) - k + 1
    out = parts[0][0][:n].copy()
    for level, at, _ in parts[1:]:
        out = mix(out * odd + level[at : at + n])
    return out


#: What a worker process remembers between tasks of one operator: by name, dicts that release() may empty.
memories: list[dict] = []


def release() -> None:
    """Give up what other operators' tasks left in this worker process."""
    if any(memories):
        for m in memories:
            m.clear()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def release_above(mb: int) -> None:
    """release() if this process holds more: for the end of a task whose worker may then wait through other stages."""
    with contextlib.suppress(OSError):
        with open("/proc/self/statm") as f:
            if int(f.read().split()[1]) * resource.getpagesize() > mb << 20:
                release()


def roomy(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a copy with more room behind it, so that it has n elements at least."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, len(a) * 3 // 2), a.dtype)
    out[: len(a)] = a
    return out


class Tokens:
    """Ids of texts under a tokenizers file, the same as encode(add_special_tokens=False) gives, but with a memory of pieces.

    A file that splits texts in another way than the byte-level pattern, or changes them first, is left to the library, and
    so are texts with characters whose class some version of Unicode has changed. Other texts are cut into the pattern's
    pieces here, a batch at once. Pieces of up to SHORT bytes are looked up in a hash table by two numbers that hold
    all their bytes, longer ones in a dict. A new piece is encoded by the library once.
    memory: how many pieces are remembered at most; beyond it the first quarter stays, as frequent ones come early.
    """

    LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏА-я一-龥ぁ-ゖァ-ヺ"
    NUMBER = "0-9²³¹¼-¾"
    PLAIN = re.compile(rf"[\t-\r\x20-\x7e¡-ɏ‐-‧‰-⁞₠-€{LETTER}]*").fullmatch
    #: The byte-level alphabet: bytes without a printable character of their own stand for characters from 256 on.
    BYTES = dict(zip((b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)), range(256, 512), strict=False))
    #: What the pattern tells apart, by code point: white space 0, letters 1, digits 2, others 3.
    CLASS = np.full(1 << 16, 3, np.uint8)
    for _found, _kind in ((r"[\t-\r ]", 0), (f"[{LETTER}]", 1), (f"[{NUMBER}]", 2)):
        CLASS[[ord(c) for c in re.findall(_found, "".join(map(chr, (*range(0xD800), *range(0xE000, 1 << 16)))))]] = _kind
    SHORT = 15

    def __init__(self, path: str, memory: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        told = json.loads(self.tokenizer.to_str())
        split, model = told["pre_tokenizer"] or {}, told["model"]
        as_known = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.as_known = as_known and told["normalizer"] is None and told["truncation"] is None and told["padding"] is None and model["type"] == "BPE" and not model.get("dropout")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # by place: the ids, and the two numbers of a short piece, whose place is in the table; of long ones it is in the dict
        self.n, self.n_ids = 0, 0
        self.flat, self.at, self.size = np.zeros(1024, np.uint32), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.low, self.high = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.index = {}
        self.rebuild()

    def forget(self) -> None:
        """Keep what was learnt first."""
        n = self.memory // 4
        self.index = {k: v for k, v in self.index.items() if v < n}
        self.n, self.n_ids = n, int(self.size[:n].sum())
        self.rebuild()

    def rebuild(self) -> None:
        """The table anew, twice as large as there are pieces at least."""
        self.bits = max(12, (2 * self.n).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.enter(np.flatnonzero(self.high[: self.n]))

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the search for pieces begins in the table."""
        h = low * np.uint64(_POWER[0] | 1) ^ high * np.uint64(_POWER[1] | 1)
        return ((h ^ h >> np.uint64(32)) * np.uint64(_POWER[0] | 1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def enter(self, places: np.ndarray) -> None:
        """Put pieces, each once, into the table; of those that meet at a free slot one stays and the others go on."""
        slot, last = self.slots(self.low[places], self.high[places]), (1 << self.bits) - 1
        while len(places):
            free = self.table[slot] < 0
            self.table[slot[free]] = places[free]
            left = self.table[slot] != places
            places, slot = places[left], slot[left] + 1 & last

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The places of short pieces, -1 where unknown."""
        slot, last = self.slots(low, high), (1 << self.bits) - 1
        place = self.table[slot].astype(np.int64)
        open_ = np.flatnonzero(place >= 0)
        while len(open_):
            p = place[open_]
            open_ = open_[(self.low[p] != low[open_]) | (self.high[p] != high[open_])]
            slot[open_] = slot[open_] + 1 & last
            place[open_] = self.table[slot[open_]]
            open_ = open_[place[open_] >= 0]
        return place

    def learn(self, pieces: list[bytes], low: np.ndarray, high: np.ndarray) -> None:
        """Encode new pieces, given once each, and remember their ids behind what is known."""
        tokenize, plain = self.tokenizer.model.tokenize, self.BYTES
        coded = [[t.id for t in tokenize(p.decode("latin-1").translate(plain))] for p in pieces]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        n, n_ids = self.n + len(coded), self.n_ids + int(size.sum())
        self.flat = roomy(self.flat, n_ids)
        self.at, self.size, self.low, self.high = (roomy(x, n) for x in (self.at, self.size, self.low, self.high))
        self.flat[self.n_ids : n_ids] = np.fromiter(itertools.chain.from_iterable(coded), np.uint32, n_ids - self.n_ids)
        self.at[self.n : n], self.size[self.n : n] = self.n_ids + np.cumsum(size) - size, size
        self.low[self.n : n], self.high[self.n : n] = low, high
        self.n, self.n_ids = n, n_ids

    def long_places(self, pieces: list[bytes]) -> np.ndarray:
        """The places of long pieces; new ones are learnt."""
        new, n = list(dict.fromkeys(p for p in pieces if p not in self.index)), self.n
        if new:
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
            self.learn(new, *np.zeros((2, len(new)), np.uint64))
        return np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))

    def short_places(self, raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The places of the short pieces that lie at start in raw, which has 16 bytes more; new ones are learnt."""
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))  # the eight bytes from each place on
        low = eight[start] & _BYTES[np.minimum(size, 8)]
        high = eight[start + 8] & _BYTES[np.maximum(size - 8, 0)] | size.astype(np.uint64) << np.uint64(56)
        place = self.find(low, high)
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            new = {raw[a : a + k]: i for a, k, i in zip(start[unknown].tolist(), size[unknown].tolist(), unknown.tolist(), strict=True)}
            one, n = np.fromiter(new.values(), np.int64, len(new)), self.n
            self.learn(list(new), low[one], high[one])
            if 2 * self.n > len(self.table):
                self.rebuild()
            else:
                self.enter(np.arange(n, self.n))
            place[unknown] = self.find(low[unknown], high[unknown])
        return place

    def cut(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pattern's pieces start in the bytes of all texts: at each run of one class, but a space before a run
        of others is its own, the last of several white characters is apart, and so are the endings after an apostrophe."""
        if len(data) == sum(map(len, texts)):
            kind = self.CLASS[data]
        else:
            points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
            kind = np.repeat(self.CLASS[points], 1 + (points >= 0x80) + (points >= 0x800))
        first = np.zeros(len(data) + 1, bool)  # of a text
        first[offsets] = True
        start = first[:-1].copy()
        start[1:] |= kind[1:] != kind[:-1]
        after = np.flatnonzero(start[1:] & ~first[1:-1] & (kind[1:] > 0) & (kind[:-1] == 0)) + 1
        start[after - 1] = True
        start[after[data[after - 1] == 32]] = False
        mark = np.flatnonzero(start & (data == 39))
        mark = mark[~first[mark + 1]]
        mark = mark[kind[mark + 1] == 1]
        one, two = data[mark + 1], np.where(first[mark + 2], 0, data[np.minimum(mark + 2, len(data) - 1)])
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        ends = short | ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        after = (mark + 3 - short)[ends]
        start[mark[ends] + 1] = False
        start[after[after < len(data)]] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """An array of uint32 ids for each text."""
        plain = [self.as_known and bool(self.PLAIN(t)) and not any(s in t for s in self.special) for t in texts]
        known = iter(self.encode_plain([t for t, ok in zip(texts, plain, strict=True) if ok]))
        return [next(known) if ok else np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t, ok in zip(texts, plain, strict=True)]

    def encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        coded = [t.encode() for t in texts]
        raw, offsets = b"".join([*coded, bytes(16)]), np.cumsum([0, *map(len, coded)])
        start = self.cut(texts, np.frombuffer(raw, np.uint8)[: offsets[-1]], offsets)
        if self.n + len(start) > self.memory and self.n > self.memory // 2:
            self.forget()
        n, place = np.diff(start, append=offsets[-1]), np.empty(len(start), np.int64)
        short, long = np.flatnonzero(n <= self.SHORT), np.flatnonzero(n > self.SHORT)
        place[short] = self.short_places(raw, start[short], n[short])
        place[long] = self.long_places([raw[a : a + k] for a, k in zip(start[long].tolist(), n[long].tolist(), strict=True)])
        size = self.size[place]
        ids = gather(self.flat, self.at[place], size)
        cuts = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, offsets)].tolist()
        return [ids[a:b] for a, b in itertools.pairwise(cuts)]


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of flat that start at at and have size elements, one after the other."""
    return flat[np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def with_key(df: DataFrame) -> tuple[DataFrame, str]:
    """df with the row key of keyed() under a name that df hasn't, and that name."""
    pin_scans(df.sparkSession)
    name = "rid"
    while any(c.lower().startswith(name) for c in df.columns):  # so names that begin with it are free, too
        name = f"_{name}"
    return df.withColumn(name, F.monotonically_increasing_id()), name
