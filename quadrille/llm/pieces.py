"""The fixed public piece vocabulary. Its path is a parameter; the file is read by
Spark, so it may lie in any store, and its bytes (0.5 MB) travel in the task closure."""

from __future__ import annotations

from pyspark.sql import SparkSession

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The space mark of SentencePiece.
MARK = "▁"


def model_bytes(spark: SparkSession, path: str = MODEL) -> bytes:
    url = path if "://" in path else f"file://{path}"
    try:
        return bytes(spark.read.format("binaryFile").load(url).select("content").first()[0])
    except Exception:
        with open(path, "rb") as f:  # a file that only the driver has
            return f.read()


class Vocabulary:
    """Pieces with ids and scores; bytes of characters that have no piece."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.id = {sp.id_to_piece(i): i for i in range(n) if not special[i] and not sp.is_byte(i)}
        self.piece = {i: p for p, i in self.id.items()}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
