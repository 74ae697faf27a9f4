"""The operators' building blocks against brute force, without Spark."""

import gzip
import itertools

import numpy as np
import pyarrow as pa
import pytest

from catadrift.llm import languages, lines, neighbours, repeats, similar, texts, tokens, toxicity, warc


def rng(seed=0):
    return np.random.default_rng(seed)


def test_span_hashes_depend_on_the_content_only():
    data = np.frombuffer(b"abcabcXabc", np.uint8)
    spans = texts.Spans(data, texts.byte_values())
    found = spans.hash(np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert found[0] == found[1] == found[2] != found[3]
    assert (spans.fixed(3)[[0, 3, 7]] == found[0]).all()


def test_shingles_of_short_and_empty_texts():
    data, offsets = texts.flat(pa.array(["A b", None, "", "a B", "a b c d e", "a b c d e f", " \t\n"]))
    owner, found = texts.shingles(data, offsets, 5)
    assert np.bincount(owner, minlength=7).tolist() == [1, 0, 0, 1, 1, 2, 0]
    assert found[0] == found[1]
    assert texts.flat(pa.chunked_array([], pa.string()))[1].tolist() == [0]


def test_perfect_hash_is_minimal_and_perfect():
    keys = rng().integers(0, 1 << 63, size=(5000, 2)).astype(np.uint64)
    levels, place = lines.build_hash(keys[:, 0], keys[:, 1])
    assert sorted(place) == list(range(5000))
    assert (lines.look_up(levels, keys[:, 0], keys[:, 1], 5000) == place).all()


def test_previous_smaller():
    for seed in range(20):
        x = rng(seed).permutation(60)
        want = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(60)]
        assert repeats.previous_smaller(x).tolist() == want


@pytest.mark.parametrize("length", [8, 11, 16, 25])
def test_previous_factors(length):
    for seed in range(10):
        data = rng(seed).integers(0, 2, size=300).astype(np.uint8)
        starts = np.arange(300 - length + 1)
        got = repeats.repeated_starts(data, starts, starts, length)
        seen, want = set(), []
        for s in starts:
            want.append(data[s : s + length].tobytes() in seen)
            seen.add(data[s : s + length].tobytes())
        assert got.tolist() == want


def test_similar_sets_share_a_signature():
    """Whatever the sizes, and with as many differences as similarity allows."""
    r = rng(3)
    for size in [1, 2, 3, 4, 5, 7, 9, 12, 17, 25, 40, 80, 200, 500]:
        for _ in range(6):
            a = r.integers(0, 1 << 62, size=size).astype(np.uint64)
            gone = int(r.integers(0, size // 5 + 1))
            most = int((size - gone) / 0.8) - size
            b = np.r_[a[gone:], r.integers(0, 1 << 62, size=int(r.integers(0, most + 1)) if most > 0 else 0).astype(np.uint64)]
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            found = []
            for x in (a, b):
                band = int(np.searchsorted(similar.bands(), len(x), side="right") - 1)
                codes = [c for t in (band, band + 1) for _, c in similar.signatures(np.zeros(len(x), np.int64), x, 1, t)]
                found.append(set(np.concatenate(codes).tolist()))
            assert found[0] & found[1], (size, gone)


def joined(n, pairs):
    """The smallest node of each node's component."""
    root = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return root


@pytest.mark.parametrize("blocks", [1, 4])
def test_groups_join_what_is_similar(blocks):
    r = rng(4)
    base = r.integers(0, 1 << 62, size=60).astype(np.uint64)
    sets = [np.unique(np.r_[base[r.random(60) > 0.1 * (i % 4)], r.integers(0, 1 << 62, size=i % 5).astype(np.uint64)]) for i in range(120)]
    names = r.permutation(1000)[:120] - 500
    band = int(np.searchsorted(similar.bands(), 60, side="right") - 1) + 1
    own = np.arange(120) % blocks
    rows = [
        {"first": i, "second": j, "g": 7, "band": band, "class": int(names[x]), "root": int(names[x]), "own": int(own[x])}
        for i in range(blocks) for j in range(i, blocks) for x in range(120) if own[x] in (i, j)
    ]
    held = pa.table({"node": [int(x) for x in names], "elements": [x.tobytes() for x in sets]})
    want = []
    for i, j in itertools.combinations(range(120), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            want.append((i, j))
    place = {int(x): i for i, x in enumerate(names)}
    got = [(place[a], place[b]) for a, b in zip(*similar.group_links(pa.Table.from_pylist(rows), held).to_pydict().values(), strict=True)]
    assert len(got) < 120 and {tuple(sorted(p)) for p in got} <= set(want)
    assert joined(120, got) == joined(120, want)


def test_open_members_have_a_possible_partner():
    """Every member of a similar pair of two components stays, over one block or several; members of other groups don't count."""
    r = rng(5)
    base = r.integers(0, 1 << 62, size=60).astype(np.uint64)
    sets = [np.unique(base[r.random(60) > 0.05 * (i % 4)]) if i % 3 else r.integers(0, 1 << 62, size=60).astype(np.uint64) for i in range(90)]
    names = [int(x) for x in r.permutation(1000)[:90] - 500]
    band = int(np.searchsorted(similar.bands(), 60, side="right") - 1) + 1
    cell = pa.table({
        "node": names, "level": [band] * 90, "size": [len(x) for x in sets],
        "sketch": [similar.sketch_rows(np.zeros(len(x), np.int64), x, 1, band)[0].tobytes() for x in sets],
    })
    rows = [
        {"shard": 0, "first": i, "second": j, "g": g, "band": band, "class": names[x], "root": x % 7, "own": x % 2}
        for g in (7, 8) for i in range(2) for j in range(i, 2) for x in range(45 * (g - 7), 45 * (g - 6)) if x % 2 in (i, j)
    ]
    want = set()
    for a, b in itertools.combinations(range(90), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if a % 7 != b % 7 and (a < 45) == (b < 45) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            i, j = sorted((a % 2, b % 2))
            want |= {(7 + (a >= 45), i, j, names[x]) for x in (a, b)}
    got = {(x["g"], x["first"], x["second"], x["class"]) for x in similar.open_members(pa.Table.from_pylist(rows), cell).to_pylist()}
    assert want and want <= got and not any(names.index(x) % 3 == 0 for *_, x in got)


def test_signatures_stay_short_over_many_shards():
    """Sizes and counts, repeated with the class in every shard, take about a byte each once compressed."""
    r = rng(6)
    name = np.repeat(r.integers(0, 1 << 62, size=1000).astype(np.uint64), 100)
    size = np.repeat(r.integers(200, 400, size=1000), 100).astype(np.uint32)
    code = r.integers(0, 1 << 62, size=100_000).astype(np.uint64)
    batch = similar._signed([name], [size], [code], 200)
    held = [b"".join(batch[c].to_pylist()) for c in ("classes", "sizes", "counts", "codes")]
    assert len(held[3]) == 4 * len(code)
    runs = len(held[0]) // 8
    assert runs > 30_000
    extra = sum(len(pa.compress(x, codec="lz4_raw")) for c in ("sizes", "counts") for x in batch[c].to_pylist())
    assert extra < 2.5 * runs
    back = [np.cumsum(similar.from_planes(x)) for x in batch["sizes"].to_pylist()]
    assert {int(x) for x in np.concatenate(back)} == {int(x) for x in size}
    assert sum(int(similar.from_planes(x).sum()) for x in batch["counts"].to_pylist()) == len(code)


def test_hilbert_keys_visit_every_cell_next_to_the_last():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    key = neighbours.hilbert_keys(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_nearest_breaks_ties_by_id():
    x = np.ones((30, 4))
    ids = rng().permutation(30)
    (_, found, score), = neighbours.nearest(ids, x, np.array([5]), np.ones((1, 4)), 4)
    assert found.tolist() == [0, 1, 2, 3] and (score == 4).all()


def test_nearest_counts_ids_not_rows():
    ids = np.array([9, 8, 7, 8, 8, 6, 5])
    x = np.array([1.0, 5, 4, 7, 6, 3, 2])[:, None]
    (_, found, score), = neighbours.nearest(ids, x, np.array([7]), np.ones((1, 1)), 3)
    assert found.tolist() == [8, 6, 5] and score.tolist() == [7, 3, 2]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = tokens.default_path()
    bpe, library = tokens.Bpe(path), Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    r = rng(5)
    odd = ["", " ", "a", "aaaa" * 99, "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "it's we'll  DON'T\n\n x", "é中文\U0001f600 ٣ ²", "\t \x1c\x85　b"]
    odd += ["".join(chr(c) for c in r.integers(32, 0x2FF, size=int(r.integers(1, 120)))) for _ in range(300)]
    odd += ["".join(r.choice(list("abAB \n"), size=int(r.integers(1, 90)))) for _ in range(300)]
    want = [e.ids for e in library.encode_batch(odd, add_special_tokens=False)]
    got = bpe.encode(odd)
    assert [g.tolist() for g in got] == want
    assert [bpe.decode(g) for g in got] == [library.decode(w, skip_special_tokens=False) for w in want]
    broken = np.array([200, 201, 50256, 5])
    assert bpe.decode(broken) == library.decode(broken.tolist(), skip_special_tokens=False)


def test_forward_backward_against_all_paths():
    r = rng(6)
    emit, moves, start = r.normal(size=(5, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    new = np.array([True, False, False, True, False])
    prob, pairs, total = languages.forward_backward(emit, new, moves, start)
    want, sums, logs = np.zeros((5, 3)), np.zeros((3, 3)), 0.0
    for chain in ([0, 1, 2], [3, 4]):
        weight = {}
        for path in itertools.product(range(3), repeat=len(chain)):
            s = start[path[0]] + sum(emit[t, y] for t, y in zip(chain, path, strict=True)) + sum(moves[a, b] for a, b in itertools.pairwise(path))
            weight[path] = np.exp(s)
        z = sum(weight.values())
        logs += np.log(z)
        for path, w in weight.items():
            for t, y in zip(chain, path, strict=True):
                want[t, y] += w / z
            for a, b in itertools.pairwise(path):
                sums[a, b] += w / z
    assert np.allclose(prob, want) and np.allclose(pairs, sums) and np.isclose(total, logs)


def test_the_penalty_takes_the_group_out_of_the_score():
    bad = [f"the {g} people are awful idiots number {i}" for i in range(60) for g in ("muslim",)]
    good = [f"the {g} people sang a song number {i}" for i in range(60) for g in ("christian", "hindu")]
    toxic = [1] * len(bad) + [0] * len(good)

    def change(penalty):
        weights, _ = toxicity.train(bad + good, toxic, penalty=penalty)
        pair = [toxicity.text_features([t]) for t in ("a muslim man", "a christian man")]
        return abs(float(weights[pair[0][1]].sum() - weights[pair[1][1]].sum()))

    assert change(5.0) < 0.2 * change(0.0)


def test_counterfactuals_swap_within_a_kind():
    said, swapped = toxicity.counterfactuals(["No group here. The Old man.\nx"], (("old", "young"), ("man", "woman")))
    assert said == [" The Old man."] * 2 and swapped == [" The young man.", " The Old woman."]


def test_counterfactuals_are_drawn_from_all_texts():
    texts = [f"Text {i} names an old man." for i in range(1000)]
    said, swapped = toxicity.counterfactuals(texts, (("old", "young"),), limit=100)
    places = [texts.index(x) for x in said]
    assert len(said) == 100 and places == sorted(places) and places[0] < 100 and places[-1] >= 900
    assert swapped == [x.replace("old", "young") for x in said]


@pytest.mark.parametrize("size", [0, 50, 17_000_000])
def test_members_end_with_a_zero_byte(size):
    content = warc.record(1, "http://x/\r\né y", b"a" * size, "d", None)
    packed = warc.member(content)
    assert packed[-1] == 0 and gzip.decompress(packed) == content
    assert b"x/%0D%0A%C3%A9%20y\r\n" in content


def test_reader_checks_framing_and_digests():
    import hashlib

    body = b"payload " * 40_000
    whole = warc.record(7, None, body, hashlib.sha256(body).hexdigest(), None)
    again = warc.record(None, "u", body, hashlib.sha256(body).hexdigest(), 7)
    rows = list(warc.read_records(warc.member(whole) + warc.EMPTY + warc.member(again)))
    assert [(r["id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows] == [(7, "response", None, len(body)), (None, "revisit", 7, len(body))]
    assert rows[0]["payload"] == body
    for broken in (whole.replace(b"payload p", b"payload q"), whole[:-4], whole + b"x", whole.replace(b"WARC/1.1", b"HTTP/1.1", 1)):
        with pytest.raises(ValueError):
            list(warc.read_records(warc.member(broken)))
    with pytest.raises(ValueError):
        list(warc.read_records(warc.member(whole)[:-9]))
