"""Short ways that the operators take, against the plain ones."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from deltaboard.llm import pieces, token_files


def test_beginnings_are_found_in_buckets():
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["▁the", "▁", "t", "th", "▁zqxj", "漢", "ß", "\U0001f600"]
    hashes = np.array([model._hash(t) for t in texts], dtype=np.uint64)
    at, known = model.places(hashes)
    plain = {model.model.id_to_piece(n): n for n in range(model.model.get_piece_size()) if model.content[n]}
    for text, place, found in zip(texts, at, known):
        assert found == any(p.startswith(text) for p in plain)
        if text in plain and found:
            assert model.numbers[place] == plain[text]


def test_segments_are_the_pattern_s():
    rng = np.random.default_rng(4)
    letters = np.array([*"aéb...", *"  \n\n", "\0x", "▁"], dtype=object)
    for size in rng.integers(1, 20, 5000):
        text = "".join(rng.choice(letters, size))
        assert pieces._segments(text) == pieces.SEGMENT.findall(pieces.SPACE + text.replace(" ", pieces.SPACE))


def test_draws_take_the_first_arc_above_the_fraction():
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    graph = pieces.Lattices(model, ["the other thing \U0001f600 thereabouts", "another"])
    rng = np.random.default_rng(3)
    states = rng.integers(0, len(graph.at) - 1, 2000)
    fractions = rng.random(2000)
    assert np.array_equal(graph.drawn(states, fractions), np.searchsorted(graph.edges, states + fractions, side="right"))


def same_rows(graph, other, seeds):
    rows = []
    for of in (graph, other):
        found = pieces.sample_all(of, seeds, 2)
        rows.append([[(of.ids_of(p.arcs).tolist(), p.total, score) for p, score in f] + [below] for f, below in found])
    assert rows[0] == rows[1]


def random_texts(rng, count):
    words = ["the", "thereabouts", "otherwise", "été", "漢字", "\U0001f600x", "", "\n", "▁", "zq", "1234567", "of"]
    return [" ".join(rng.choice(words, rng.integers(0, 12))) for _ in range(count)]


def test_segments_that_come_again_are_laid_out_once(monkeypatch):
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(6)
    graph, laid = pieces.Lattices(model), []
    plain = pieces.Lattices._arcs
    monkeypatch.setattr(pieces.Lattices, "_arcs", lambda of, codes, stop: laid.append(len(codes)) or plain(of, codes, stop))
    for turn in range(8):
        texts = random_texts(rng, 20)
        laid.clear()
        graph.add(texts)
        assert not turn or sum(laid) < sum(map(len, texts)) / 2
        same_rows(graph, pieces.Lattices(model, texts), list(range(20)))
        if turn % 3 == 2:
            graph.trim(10**6 if turn == 2 else 0)
            assert (len(graph.at) > 1) == (turn == 2)
    laid.clear()
    graph.add(texts)
    graph.add(texts)
    graph.trim(10**6)
    graph.add(texts)
    assert sum(laid[1:]) == 0


def test_segments_of_one_digest_stay_apart(monkeypatch):
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(7)
    texts = random_texts(rng, 30)
    exact = pieces.Lattices(model, texts)
    monkeypatch.setattr(pieces, "_digests", lambda codes, places, begins: codes[begins].astype(np.uint64) % np.uint64(3))
    graph = pieces.Lattices(model, texts[:10])
    graph.add(texts)
    same_rows(graph, exact, list(range(30)))


def test_words_with_marks_need_no_pattern():
    codec = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    codec.pattern = regex.compile("(?!)")
    texts = ["Plain words, with some] marks; need none.", "Über été, señor!!!"]
    found = [np.frombuffer(ids, dtype="<u4").tolist() for ids in codec.encode(texts)]
    assert found == [codec.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_odd_texts_are_the_library_s():
    codec = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(5)
    parts = ["a", "é", "×", " ", "'s", "'", "\n", ",", "%", "1", "\0", " ", "漢", "word", " the"]
    texts = ["".join(rng.choice(parts, size)) for size in rng.integers(0, 30, 3000)]
    found = [np.frombuffer(ids, dtype="<u4").tolist() for ids in codec.encode(texts)]
    assert found == [codec.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_segments_are_laid_out_in_bounded_turns(monkeypatch):
    """The same samples as laid out at once, with less in memory for a while and kept."""
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(5)
    texts = ["".join(chr(c) for c in rng.choice([32, *range(97, 107)], 20_000)) for _ in range(10)] + ["", "x" * 500]
    plain, laid = pieces.Lattices._arcs, []
    monkeypatch.setattr(pieces.Lattices, "_arcs", lambda of, codes, stop: laid.append(len(codes)) or plain(of, codes, stop))
    graph = pieces.Lattices(model, texts)
    assert sum(laid) > 150_000 and max(laid) < 70_000
    monkeypatch.setattr(pieces, "LAID_CHARS", 1 << 30)
    same_rows(graph, pieces.Lattices(model, texts), list(range(len(texts))))
    kept = sum(x.whole.nbytes for x in vars(graph).values() if isinstance(x, pieces._Grown))
    assert kept < 25 * len(graph.ids) + 16 * len(graph.at)


def test_only_a_run_of_a_batch_is_held_as_strings():
    texts = [None, "", *["ab" * 500] * 4000, "c"]
    batches = [pa.record_batch({"doc_id": [None, *range(1, len(texts))], "text": texts}), pa.record_batch({"doc_id": [7], "text": ["d"]})]
    tracemalloc.start()
    try:
        runs = pieces._runs(iter(batches))
        first = next(runs)
        assert tracemalloc.get_traced_memory()[1] < 1_000_000
    finally:
        tracemalloc.stop()
    found = [first, *runs]
    assert all(pieces.RUN_CHARS <= sum(map(len, t)) < pieces.RUN_CHARS + 1000 for _, t in found[:-2])
    assert [d for docs, _ in found for d in docs] == [None, *range(1, len(texts)), 7]
    assert [t for _, of in found for t in of] == ["", *texts[1:], "d"]
