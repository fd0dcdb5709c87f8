"""The byte-pair encoder against the tokenizers library, whole and by its parts."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tilewright.llm import bpe, queries

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def same(library, texts):
    for text, ids in zip(texts, bpe.encoder(FILE)(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text)
        assert bpe.merges(FILE).decode(ids.astype(np.int64)) == library.decode(want, skip_special_tokens=False) == text


def test_odd_texts(library):
    """Apostrophes, runs of blanks, controls, marks, digits of other scripts, new letters, special tokens, repeated bytes."""
    rng = random.Random(7)
    parts = ["a", "b", "s", "'", "'s", "'re", "'LL", " ", "  ", "\n", "\t", "\x85", "\xa0", " ", "1", "²", "Ⅷ", "é", "é", "ß", "中", "文", "😀", "՘", "࢏", "\U00011de0", "‍", "<|endoftext|>", "<|endof", "the", "ing", "tion", "_", "-", "...", "=====", "\x1c", "\x00", "A", "aa", "٣"]
    same(library, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)])
    same(library, ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(97, 123)])) for _ in range(rng.randint(1, 80))) for _ in range(2000)])
    same(library, ["", "a" * 5001, "ab" * 3000, " " * 4000 + "x", "xyz" * 400 + "࢏", "é" * 1500])


def test_pairs_and_dead_ends(library):
    """What the table says of two tokens is what the library makes of their bytes; greedy matches do fail, so places are left again."""
    table, rng, failed = bpe.merges(FILE), random.Random(3), 0
    plain = [i for i, t in enumerate(table.bytes[:50256]) if t.isalpha() and t.isascii()]
    for _ in range(3000):
        a, b = rng.choice(plain), rng.choice(plain)
        text = (table.bytes[a] + table.bytes[b]).decode()
        assert table.apart(a, b) == (library.encode(text, add_special_tokens=False).ids == [a, b])
        failed += not table.apart(a, b)
    assert failed > 100


def test_longest_tokens():
    table = bpe.merges(FILE)
    tokens, text = {t for t in table.bytes if t is not None}, b"unbelievable antidisestablishment" * 40
    got = table._longest(np.frombuffer(text + text[:300], dtype=np.uint8), np.array([0, len(text)]), np.array([len(text), len(text) + 300]))
    for i in (*range(60), *range(len(text), len(text) + 250)):
        whole = text if i < len(text) else text[:300]
        k = i if i < len(text) else i - len(text)
        assert table.bytes[got[i]] == next(whole[k : k + n] for n in range(40, 0, -1) if whole[k : k + n] in tokens and k + n <= len(whole))


def test_decoding_of_any_ids(library):
    """Bytes that are no UTF-8 are replaced as the library does; ids that the file does not have are left out."""
    rng = random.Random(5)
    for _ in range(3000):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert bpe.merges(FILE).decode(np.array(ids, dtype=np.int64)) == library.decode(ids, skip_special_tokens=False)
    assert bpe.merges(FILE).decode(np.array([64, 99999, -1, 65], dtype=np.int64)) == "ab"


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        bpe.merges(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.load(open(FILE))
    spec["model"]["merges"].append(["Ġt", "he"])  # a second way to a token
    (tmp_path / "twice.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="more than one merge"):
        bpe.merges(str(tmp_path / "twice.json"))


def test_tables(spark, hard, sf, library):
    rows = bpe.decode(bpe.encode(hard, FILE), FILE).collect()
    assert len(rows) == hard.count()
    for r in rows:
        assert list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert bpe.decode(bpe.encode(hard.limit(0), FILE), FILE).count() == 0
    with pytest.raises(ValueError, match="already"):
        bpe.encode(hard.selectExpr("text", "1 AS IDS"), FILE)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op12_backtracking_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_one_worker_encodes_and_decodes(spark, hard, sf):
    """Two passes had two workers for each task, each with the automaton, and texts went through both."""
    plan = queries.op12_backtracking_bpe(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    got = bpe.round_trip(hard, FILE)
    want = bpe.decode(bpe.encode(hard, FILE).drop("text"), FILE)
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == hard.count()
    assert bpe.round_trip(hard.limit(0), FILE).count() == 0
    for column in ("ids", "DECODED"):
        with pytest.raises(ValueError, match="already"):
            bpe.round_trip(hard.selectExpr("text", f"1 AS {column}"), FILE)
