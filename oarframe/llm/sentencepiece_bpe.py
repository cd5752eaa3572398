"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut wherever no piece of the vocabulary could span the cut, so that equal words are
encoded once per batch.  The distinct words' characters form one flat symbol array; each round
finds the best pair rank of every word by a segmented minimum, merges its occurrences from left to
right, and compacts, until no pair is left.  Characters without a piece fall back to byte pieces.

A merged piece may form, with a neighbour, a piece of better rank than its own.  For such pieces a
round merges the leftmost occurrence only, which is the order the library follows; for all others
the simultaneous merge gives the same result.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BASE, fresh_name, mix, pieces, text_buffers

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NONE = np.iinfo(np.int32).max


def _fields(blob: bytes):
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = blob[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(blob):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, blob[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if kind == 5 else "<d", blob[at : at + size])[0]
            at += size


class PieceModel:
    """The tables of one model file: pieces, pair merges and byte pieces.

    Only BPE models with an identity normaliser, a dummy prefix, kept white space and byte fallback
    are supported; others raise ValueError.
    """

    def __init__(self, blob: bytes):
        pieces, scores, kinds, trainer, normalizer = [], [], [], {}, {}
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode("utf-8"))
                scores.append(piece.get(2, 0.0))
                kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1):
            raise ValueError("only BPE models with identity normalisation, dummy prefix and byte fallback are supported")
        self.pieces = pieces
        self.eos = trainer.get(42, 2)
        normal = [i for i, k in enumerate(kinds) if k == _NORMAL]
        ids = {pieces[i]: i for i in normal}
        by_score = sorted(normal, key=lambda i: (-scores[i], i))
        self.rank_to_id = np.array(by_score, np.int32)
        rank = {i: r for r, i in enumerate(by_score)}
        self.bytes_ids = np.zeros(256, np.int32)
        for i, k in enumerate(kinds):
            if k == _BYTE:
                self.bytes_ids[int(pieces[i][1:-1], 16)] = i
        # Symbols are ids of single characters or merged pieces; -1 stands for a character without a piece.
        self.chars = {ord(p): i for p, i in ids.items() if len(p) == 1}
        pairs, late, spans = {}, set(), set()
        for piece, i in ids.items():
            spans.update(zip(piece, piece[1:]))
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * (1 << 32) + right] = rank[i]
                    late.update(x for x in (left, right) if len(pieces[x]) > 1 and rank[i] < rank[x])
        keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in keys.tolist()], np.int32)
        self.pair_keys = keys
        self.one_at_a_time = np.zeros(len(pieces), bool)
        self.one_at_a_time[list(late)] = True
        self.spans = np.array(sorted((ord(a) << 32) + ord(b) for a, b in spans), np.int64)
        table_size = max(max(self.chars, default=0) + 2, 1 << 16)
        self.char_table = np.full(table_size, -1, np.int32)
        self.char_table[list(self.chars)] = list(self.chars.values())
        # Pairs of frequent characters are looked up in a bitmap; the others in the sorted list.
        self.span_map = np.zeros((513, 513), bool)
        for a, b in spans:
            if (x := _fold(ord(a))) < 512 and (y := _fold(ord(b))) < 512:
                self.span_map[x, y] = True
        self.surface = [b"" if k in (_CONTROL,) else b" \xe2\x81\x87 " if k == _UNKNOWN else bytes([int(p[1:-1], 16)]) if k == _BYTE else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds)]
        self.is_byte = np.array([k == _BYTE for k in kinds])
        self.is_control = np.array([k == _CONTROL for k in kinds])

    def joinable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether some piece has these two characters side by side."""
        x, y = _fold(left), _fold(right)
        out = self.span_map.ravel()[x.astype(np.int32) * 513 + y]
        rare = np.flatnonzero((x == 512) | (y == 512))
        if len(rare):
            keys = (left[rare].astype(np.int64) << 32) + right[rare]
            at = np.minimum(np.searchsorted(self.spans, keys), len(self.spans) - 1)
            out[rare] = self.spans[at] == keys
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that each pair of symbols makes, or _NONE."""
        keys = (left.astype(np.int64) << 32) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_rank[at], _NONE)

    def merge_words(self, code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all words and where each word's ids begin; code are the characters of the words.

        `origin` remembers the first character of each symbol, for the order of the result and for
        characters that fall back to bytes.
        """
        n_words = len(starts)
        bounds = np.append(starts, len(code))
        word = np.repeat(np.arange(n_words), np.diff(bounds))
        symbol = self.char_table[np.minimum(code, len(self.char_table) - 1)]
        origin = np.arange(len(code))
        done_symbol, done_origin = [], []
        rank = np.full(len(symbol), _NONE, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        while len(symbol):
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(head, len(word)))
            best = np.minimum.reduceat(rank, head)
            live = best != _NONE
            if not live.all():  # finished words leave
                stay = np.repeat(live, sizes)
                done_symbol.append(symbol[~stay])
                done_origin.append(origin[~stay])
                symbol, origin, word, rank = symbol[stay], origin[stay], word[stay], rank[stay]
                sizes, best = sizes[live], best[live]
                if not len(symbol):
                    break
                head = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            group = word[hit]
            new_word = np.concatenate([[True], group[1:] != group[:-1]])
            # In a run of overlapping hits, every other one merges, counted from the left.
            run_start = new_word | np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            run_first = np.maximum.accumulate(np.where(run_start, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - run_first) % 2 == 0
            merged = self.rank_to_id[rank[hit]]
            take &= new_word | ~self.one_at_a_time[merged]
            at = hit[take]
            symbol[at] = merged[take]
            gone = np.zeros(len(symbol), bool)
            gone[at + 1] = True
            rank[at] = rank[at + 1]  # the pair to the right starts now where the merged symbol starts
            touched = np.zeros(len(symbol), bool)
            touched[at] = True
            keep = ~gone
            symbol, origin, word, rank, touched = symbol[keep], origin[keep], word[keep], rank[keep], touched[keep]
            touched[:-1] |= touched[1:]  # the pair to the left has changed as well
            redo = np.flatnonzero(touched)
            last = redo == len(symbol) - 1
            inside = redo[~last]
            inside = inside[word[inside] == word[inside + 1]]
            rank[redo] = _NONE
            rank[inside] = self.ranks(symbol[inside], symbol[inside + 1])
        if not done_symbol:
            return np.zeros(0, np.int32), np.zeros(n_words + 1, np.int64)
        symbol, origin = np.concatenate(done_symbol), np.concatenate(done_origin)
        order = np.argsort(origin, kind="stable")
        symbol, origin = symbol[order], origin[order]
        missing = np.flatnonzero(symbol < 0)
        width = np.ones(len(symbol), np.int64)
        parts = [chr(c).encode("utf-8", "surrogatepass") for c in code[origin[missing]].tolist()]
        width[missing] = [len(p) for p in parts]
        ids = np.repeat(symbol, width)
        if len(missing):
            put = np.concatenate([[0], np.cumsum(width)[:-1]])[missing]
            sizes = width[missing]
            place = np.repeat(put - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            ids[place] = self.bytes_ids[np.frombuffer(b"".join(parts), np.uint8)]
        per_word = np.bincount(np.repeat(np.repeat(np.arange(n_words), np.diff(bounds))[origin], width), minlength=n_words)
        return ids, np.concatenate([[0], np.cumsum(per_word)])

    def encode(self, texts: list[str], add_eos: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and len(texts)+1 offsets."""
        spaced = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        sizes = np.array([len(t) for t in spaced], np.int64)
        code = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        if len(code):
            cut = np.ones(len(code), bool)
            cut[1:] = ~self.joinable(code[:-1], code[1:])
            cut[bounds[:-1][sizes > 0]] = True
            starts = np.flatnonzero(cut)
        else:
            starts = np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(code)))
        first_of_text = np.searchsorted(starts, bounds)
        which, distinct = _distinct(code, starts, lengths)
        place = np.repeat(starts[distinct], lengths[distinct])
        heads = np.concatenate([[0], np.cumsum(lengths[distinct])])
        place = place + np.arange(heads[-1]) - np.repeat(heads[:-1], lengths[distinct])
        ids, at = self.merge_words(code[place], heads[:-1])
        count = np.diff(at)[which]
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = ids[np.repeat(at[:-1][which] - ends[:-1], count) + np.arange(ends[-1])] if len(which) else np.zeros(0, np.int32)
        offsets = ends[first_of_text]
        if add_eos:
            flat = np.insert(flat, offsets[1:], self.eos)
            offsets = offsets + np.arange(len(offsets))
        return flat.astype(np.int32), offsets

    def decode(self, ids: np.ndarray) -> str:
        """The text of one id sequence; control pieces vanish, bytes that are not UTF-8 become U+FFFD each."""
        ids = ids[~self.is_control[ids]]
        if not len(ids):
            return ""
        surface = self.surface
        if not self.is_byte[ids].any():
            text = b"".join([surface[i] for i in ids.tolist()]).decode("utf-8")
            return text[1:] if text.startswith(" ") and not self.is_byte[ids[0]] else text
        edge = np.flatnonzero(np.diff(self.is_byte[ids].astype(np.int8))) + 1
        out = []
        for run in np.split(ids, edge):
            raw = b"".join([surface[i] for i in run.tolist()])
            out.append(_decode_bytes(raw) if self.is_byte[run[0]] else raw.decode("utf-8"))
        if out[0].startswith(" ") and not self.is_byte[ids[0]]:
            out[0] = out[0][1:]
        return "".join(out)


_FOLD = np.full(1 << 16, 512, np.uint16)
_FOLD[:256] = np.arange(256)
_FOLD[ord(SPACE)] = 511


def _fold(code):
    """Characters below 256 keep their number, the space mark is 511, all others are 512."""
    return _FOLD[np.minimum(code, (1 << 16) - 1)]


def _decode_bytes(raw: bytes) -> str:
    """UTF-8 with every byte that belongs to no character replaced on its own."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode("utf-8"))
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            out.append("�")
        at += size
    return "".join(out)


def _distinct(code: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its spelling, and for each spelling one word that has it.

    A hash groups the words; then each word is compared whole with its group's first word, and if
    two spellings ever share a hash, the words are grouped by their bytes instead.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(code)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, _BASE))
    hashes = mix(np.add.reduceat((code.astype(np.uint64) + np.uint64(1)) * powers[place], starts) ^ lengths.astype(np.uint64))
    _, distinct, which = np.unique(hashes, return_index=True, return_inverse=True)
    first = distinct[which]
    if (lengths == lengths[first]).all() and (code == code[np.repeat(starts[first], lengths) + place]).all():
        return which, distinct
    raw, seen = code.astype("<u4").tobytes(), {}
    which = np.array([seen.setdefault(raw[4 * s : 4 * (s + n)], len(seen)) for s, n in zip(starts.tolist(), lengths.tolist())])
    _, distinct = np.unique(which, return_index=True)
    return which, distinct


@lru_cache(maxsize=4)
def load_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


#: Bytes of text that are encoded, and ids that are decoded, at a time; a longer text stands alone.
TEXT_AT_ONCE = 1 << 20
IDS_AT_ONCE = 1 << 18


def _pairs(batches, path: str, add_eos: bool):
    """(rows, texts, ids, offsets) of parts of about TEXT_AT_ONCE bytes."""
    model = load_model(path)
    for batch in batches:
        _, sizes = text_buffers(batch.column(0))
        for lo, hi in pieces(sizes, TEXT_AT_ONCE):
            rows = batch.slice(lo, hi - lo)
            texts = [t or "" for t in rows.column(0).to_pylist()]
            yield rows, texts, *model.encode(texts, add_eos)


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))


def encode_pieces(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", add_eos: bool = False) -> DataFrame:
    """df with the piece ids of each whole text; null and empty texts give no ids but the end id.

    Every row stands for itself, so repeated rows are kept and nothing is shuffled.  The other
    columns pass through unchanged; one already named ids_col is replaced.  model_path must be
    readable on every executor.
    """
    kept = [c for c in df.columns if c.lower() != ids_col.lower()]
    text = fresh_name(kept, "text_in")

    def run(batches):
        for rows, _, ids, at in _pairs(batches, model_path, add_eos):
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], _lists(ids, at)], names=[*kept, ids_col])

    source = df.select(F.col(f"`{text_col}`").cast("string").alias(text), *[F.col(f"`{c}`") for c in kept])
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema.add(ids_col, T.ArrayType(T.IntegerType()))
    return source.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the text that each id list stands for; a null list gives an empty text.

    Ids outside the vocabulary raise.  Other columns pass through; one named text_col is replaced.
    """
    kept = [c for c in df.columns if c.lower() != text_col.lower()]
    ids = fresh_name(kept, "ids_in")

    def run(batches):
        model = load_model(model_path)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in pieces(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), IDS_AT_ONCE):
                rows = batch.slice(lo, hi - lo)
                flat = rows.column(0).flatten().to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], np.cumsum(sizes[lo:hi], dtype=np.int64)])
                texts = [model.decode(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(texts, pa.string())], names=[*kept, text_col])

    source = df.select(F.col(f"`{ids_col}`").cast("array<int>").alias(ids), *[F.col(f"`{c}`") for c in kept])
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema.add(text_col, T.StringType())
    return source.mapInArrow(run, schema)


def encode_and_check(df: DataFrame, model_path: str, text_col: str = "text", add_eos: bool = False) -> DataFrame:
    """df without its text, with `ids`, `decoded_sha256` and `round_trip`, in one pass.

    Each part of the texts is encoded and its ids are decoded again at once, so that neither the
    decoded text nor a second worker is needed; decoded_sha256 is the digest of the decoded text in
    UTF-8, round_trip says whether it equals the text (with the piece mark read as a blank).  Null
    and empty texts have no ids but the end id, decode to nothing and count as equal.  Rows stand
    for themselves; other columns pass through, those with one of the three names are replaced.
    """
    new = ("ids", "decoded_sha256", "round_trip")
    kept = [c for c in df.columns if c.lower() not in (*new, text_col.lower())]
    text = fresh_name(kept, "text_in")

    def run(batches):
        model = load_model(model_path)
        for rows, texts, ids, at in _pairs(batches, model_path, add_eos):
            digests, same = [], []
            for t, a, b in zip(texts, at[:-1], at[1:]):
                decoded = model.decode(ids[a:b])
                digests.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                same.append(decoded == t.replace(SPACE, " "))
            arrays = [_lists(ids, at), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], *arrays], names=[*kept, *new])

    source = df.select(F.col(f"`{text_col}`").cast("string").alias(text), *[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([df.schema[c] for c in kept]).add("ids", T.ArrayType(T.IntegerType())).add("decoded_sha256", T.StringType()).add("round_trip", T.BooleanType())
    return source.mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents' ids and of the texts decoded from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode_and_check(docs, default_model(), add_eos=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), "decoded_sha256")
