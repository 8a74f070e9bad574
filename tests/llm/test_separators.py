import numpy as np
import pytest

from encore.llm import separators
from encore.llm.frames import open_store, shared_folder
from encore.llm.tokens import Encoder, default_path

TEXTS = ["one two", None, "", "a  b\n\nc <|endoftext|> d", "x " * 700, "one two", "é日本", " lead", "tail "]


@pytest.mark.parametrize(("block", "run"), [(1 << 20, 1024), (7, 3), (1, 2)])
def test_counts_match_the_tokenizer(spark, monkeypatch, block, run):
    monkeypatch.setattr(separators, "RUN", run)
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, file string")
    found = separators.token_counts(table, block=block).collect()
    plain = Encoder(default_path()).tokenizer
    expected = {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_tokens"] for r in found} == expected and len(found) == len(TEXTS)


@pytest.mark.parametrize("block", [1, 2, 3, 5, 100])
def test_stitching_and_open_tails(spark, block):
    folder = shared_folder(spark, "test-tokens")
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    files = {"a": [1, 2, 0, 0, 3, 0, 4, 5, 6], "b": [0], "c": [7, 7, 7, 7, 7], "d": [], "e": [1, 0]}
    for name, ids in files.items():
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(np.array(ids, "<u2").tobytes())
    found = separators.document_counts(separators.separators(spark, folder, list(files), end=0, block=block))
    got = {(r["file"], r["ordinal"]): (r["start"], r["n_tokens"], r["closed"]) for r in found.collect()}
    assert got == {
        ("a", 0): (0, 2, True), ("a", 1): (3, 0, True), ("a", 2): (4, 1, True), ("a", 3): (6, 3, False),
        ("b", 0): (0, 0, True), ("c", 0): (0, 5, False), ("e", 0): (0, 1, True),
    }


def test_empty_table(spark):
    assert separators.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(
    "text",
    ["a  b", " a", "a ", "a\n b", "x\n\ny", "x\n\n", "\nx", "a.\nb c!! d", "it's we'll they'll. go", "a\xa0b c", "a \xa0b", "tab\there now", "x\x00 y", "1 2 33 a1 !? ...", "wá x", "<|endoftext|> x", "a b. c"],
)
def test_encoder_gives_the_tokenizers_ids(text):
    encoder = Encoder(default_path(), most_words=3)
    for texts in ([text, "some words, some more."], [text]):
        assert encoder(texts) == encoder.plain(texts)


@pytest.mark.parametrize("text", ["Title\n\n\nName\tAge\tCity", "a   b\tc\td", "a\u00a0b\u00a0c\n\n\nd", "if x:\n\treturn\n\n\n\ty   z", "a \n b\tc\x0bd"])
def test_tabs_do_not_hide_runs_of_white_space(text):
    encoder = Encoder(default_path())
    assert encoder([text]) == encoder.plain([text])
