"""op5 compares every whole text with the original library."""

import public_tokenizers
import pytest

from astrolane.llm import spm

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_every_text_is_compared_whole(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of many") for i in range(200)] + [(200, None), (201, "")], "doc_id long, text string")
    rows = spm.encode_documents(docs, PATH).collect()
    assert len(rows) == 202 and all(r["audited"] and r["parity"] for r in rows)


def test_a_difference_between_words_is_noticed():
    codec = spm.Codec(PATH)
    assert codec.split
    theirs = codec.original

    class Odd:  # differs from the library only where a text holds two words
        def encode(self, given, **options):
            if isinstance(given, str):
                return self.encode([given])[0]
            return [x + [0] if " " in t.strip() else x for t, x in zip(given, theirs.encode(given), strict=True)]

        def __getattr__(self, name):
            return getattr(theirs, name)

    codec.original = Odd()
    assert codec.encode(["one", "two words", ""])[2].tolist() == [True, False, True]


@pytest.mark.parametrize("text", ["  ", "▁", "a\x1cb", "tab\tand\nline", "½ ü ﷽"])
def test_parity_of_odd_texts(text):
    codec = spm.Codec(PATH)
    ids, counts, same = codec.encode([text])
    assert same.tolist() == [ids.tolist() == codec.original.encode(text)]
