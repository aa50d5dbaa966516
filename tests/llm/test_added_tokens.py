import public_tokenizers
from tokenizers import Tokenizer

from embedframe.llm import packing

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = ["ab <|endoftext|> cd", "<|endoftext|>", "<|endoftext|><|endoftext|>\n", "a<|endoftext|>b", "x  <|endoftext|>  y", "<|endoftext|",
         "ñ漢🙂<|endoftext|> it's", "<|ENDOFTEXT|> <|endoftext|>.", "no token"]


def test_added_tokens_as_the_library_takes_them(spark):
    tok = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in packing.token_pieces(docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect()}
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(TEXTS)}
    assert got[0] == [397, 220, 50256, 22927, 2]
