"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The model is serialised from the vocabulary: each token's bytes are mapped to visible characters, its score is the
negative rank, normalisation is the identity, and no space is added or escaped. Texts are cut into pre-tokens by a
pattern; each pre-token is encoded for itself. Decoding maps the characters of each piece back to bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable

import numpy as np
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import map_column

#: Pre-tokens, and parts of texts, whose ids a task remembers; beyond this many it forgets them all.
CACHE_SIZE = 600_000
#: Texts that are encoded together.
AT_ONCE = 64
#: Stands between pre-tokens in what the model reads.
BETWEEN = "\ue000"
#: A space after white space.
GAP = re.compile(r"\s ")


def byte_characters() -> list[str]:
    """A visible character for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in the order of their ranks, which must be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError(f"the ranks in {path} are not 0 to {len(tokens) - 1}")
    return tokens


def serialise_model(tokens: Iterable[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the unknown piece comes last and never occurs, as every byte has a piece."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    shown, model = byte_characters(), proto.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(shown[b] for b in token), score=-float(rank), type=proto.ModelProto.SentencePiece.NORMAL)
    unknown = len(model.pieces)
    model.pieces.add(piece="<unk>", score=-float(unknown), type=proto.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = proto.TrainerSpec.BPE
    model.trainer_spec.vocab_size = unknown + 1
    model.trainer_spec.unk_id = unknown
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes texts to packed ids (little-endian unsigned 32-bit) and back, by a serialised model.

    No pre-token goes on past a space that follows a visible character, and what stands before such a space has no
    influence on the pre-tokens after it. Texts are therefore cut there first, and the ids of each part are remembered.
    Pre-tokens go to the model many at a time, with a character between them that belongs to no piece.
    """

    def __init__(self, model: bytes, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        shown = byte_characters()
        byte_of = {c: b for b, c in enumerate(shown)}
        self.unknown = self.model.get_piece_size() - 1
        self.bytes_of = [bytes(byte_of[c] for c in self.model.id_to_piece(i)) for i in range(self.unknown)]
        self.parts: dict[str, bytes] = {}
        # UTF-8 has no byte 0xFF: it stands between pre-tokens and is mapped to a character without a piece.
        self.shown = np.array([ord(c) for c in shown[:255]] + [ord(BETWEEN)], "<u2")

    def model_ids(self, pieces: list[str], counts: list[int]) -> list[bytes]:
        """Ids of runs of pre-tokens: the first counts[0] of them, the next counts[1], and so on."""
        if not pieces:
            return [b"" for _ in counts]
        joined = b"\xff".join([p.encode() for p in pieces])
        mapped = self.shown[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-16-le")
        ids = self.model.encode(mapped, num_threads=1, out_type="numpy")
        cuts = np.flatnonzero(ids == self.unknown)
        ends = np.concatenate(([0], cuts - np.arange(len(cuts)), [len(ids) - len(cuts)]))  # of each pre-token, in ids without cuts
        data = ids[ids != self.unknown].astype("<u4").tobytes()
        at = (4 * ends[np.concatenate(([0], np.cumsum(counts)))]).tolist()
        return [data[i:j] for i, j in zip(at, at[1:])]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        find, parts = self.find, self.parts
        if len(parts) > CACHE_SIZE:
            parts.clear()
        whole = [t for t in texts if GAP.search(t) or t[:1] == " "]  # no cutting there
        cut = [None if GAP.search(t) or t[:1] == " " else t.split(" ") for t in texts]
        heads = [find(words[0]) for words in cut if words]
        new = list({w for words in cut if words for w in words[1:] if w not in parts})
        pieces = [find(t) for t in whole] + heads + ([] if not new else [find(" " + w) for w in new])
        made = iter(self.model_ids([p for run in pieces for p in run], [len(run) for run in pieces]))
        by_whole, by_head = [next(made) for _ in whole], [next(made) for _ in heads]
        parts.update(zip(new, made, strict=True))
        by_whole, by_head = iter(by_whole), iter(by_head)
        return [next(by_whole) if words is None else b"".join([next(by_head), *map(parts.__getitem__, words[1:])]) for words in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, token_ids (packed little-endian unsigned 32-bit, as tokenised corpora are stored) and decoded (bytes).

    Null and empty texts have no tokens and empty bytes. Very long texts are encoded whole, one pre-token at a time.
    Repeated rows give repeated results, other columns stay (columns with the three names are replaced), empty tables
    give empty ones. The vocabulary is read on the driver and its model, of the vocabulary's size, goes to the tasks.
    """
    model = df.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(ranks_path)))

    def make():
        codec = Codec(model.value, pattern)

        def work(texts):
            ids = [x for k in range(0, len(texts), AT_ONCE) for x in codec.encode_all([t or "" for t in texts[k : k + AT_ONCE]])]
            return [len(i) // 4 for i in ids], ids, [codec.decode(i) for i in ids]

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    return map_column(df, text_col, fields, make)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
