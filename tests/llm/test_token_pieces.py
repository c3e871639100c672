"""New pieces of texts: the ids of whole texts, with few calls of the library."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from pressmill.llm import cotrain
from pressmill.llm.tokens import ChunkEncoder, default_vocabulary

ODD = ["zqxj kwvy 555-0199 (743) 1.2.3.4*** a@b.example.com $$$ 你好 caf\xe9s na\xefvé \U0001F600x", "don't we'll 's x's",
       "Upper CASE İstanbul words", "marks, behind. these; end! no.t here ..dots mid,dle ,a", "caf\xe9, na\xefve. \xdf!", "  two  blanks\t\n", "wordsend."]


def test_new_pieces_go_to_the_library_together():
    encoder = ChunkEncoder(default_vocabulary())
    texts = [*ODD, f"7-7 {encoder.between} 8-8 9-9", f"6-6 {encoder.between}5 4-4"]
    for _ in range(2):
        for text in texts:
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder._ids(text)
    fresh, calls = ChunkEncoder(default_vocabulary()), []
    library = fresh._library
    fresh._library = lambda pieces: calls.append(pieces) or library(pieces)
    text = " ".join(f"{i}-{i} inventedword{'x' * i}" for i in range(50))
    assert np.frombuffer(fresh.encode(text), "<u4").tolist() == fresh._ids(text) and not calls


def test_the_driver_gets_the_model_and_not_the_sample(spark, monkeypatch):
    rows = [(i, f"text of {zlib.crc32(str(i).encode())}", "s", "en", 10) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))

    def refused(self):
        raise AssertionError("the sample came to the driver")
    monkeypatch.setattr(type(docs), "toArrow", refused)
    assert isinstance(cotrain.fit(docs, labels), cotrain.Model)
