import pyarrow as pa

from quality_probe.llm import packing, queries


def test_special_token_strings_are_those_tokens():
    """As in the library's plain call: within words, next to them, and twice in a row."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["hello <|endoftext|> there", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|><|endoftext|>c", "<|endoftext|", "",
             "x\x01<|endoftext|>y \x01", "É<|endoftext|>é"]
    ids, borders = packing.WordEncoder(queries.tokenizer_path()).encode(pa.array(texts, pa.large_string()))
    for i, text in enumerate(texts):
        expected = [*plain.encode(text, add_special_tokens=False).ids, packing.END]
        assert ids[borders[i] : borders[i + 1]].tolist() == expected, text
