import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import packing, tokens

RANKS = f"{tokens.TOKENIZER_DIR}/{tokens.RANKS_FILE}"
SCHEMA = "doc_id long, text string, ids int, window_id int"
PACKERS = {"best fit decreasing": packing.pack_best_fit_decreasing, "online": packing.pack_online}


def test_encoding_equals_the_library():
    rng = random.Random(2)
    alphabet = list("ab Z0\u00e9\u4e2d\u0663'srtvemld.,!\n\t \u00a0\u2003\U0001f600") + ["'ll", " 're", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["", None, "x" * 5000]
    mine = tokens.tokenizer(RANKS)
    ids, bounds = mine.encode(pa.array(texts))
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == mine.library.encode_ordinary(t or "")
    assert mine.encode(pa.array([], pa.string()))[1].tolist() == [0]


def make_docs():
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma ray", "123"]) for _ in range(rng.choice([1, 5, 30, 200, 700])))) for i in range(120)]
    return docs + [(200, None), (201, ""), (None, "no id"), (5, docs[5][1]), (5, docs[5][1])]


def check_windows(rows, docs, length, end_id):
    """Every document comes back whole, once, with its end, and nothing else is in a window."""
    kind = packing.id_type(tokens.tokenizer(RANKS).n_ids)
    pieces = []
    assert len({r.window_id for r in rows}) == len(rows)
    for r in rows:
        ids, cum = np.frombuffer(r.ids, kind), r.cu_seqlens
        assert len(ids) == length and cum[0] == 0 and cum[-1] == r.n_tokens <= length and r.position_resets == cum[:-1]
        assert (ids[r.n_tokens :] == end_id).all() and len(cum) == len(r.doc_ids) + 1 == len(r.doc_offsets) + 1
        pieces += [(d, o, tuple(ids[a:b].tolist())) for d, o, a, b in zip(r.doc_ids, r.doc_offsets, cum[:-1], cum[1:], strict=True)]
    want = []
    for i, text in docs:
        ids = tokens.tokenizer(RANKS).library.encode_ordinary(text or "")
        if ids:
            ids.append(end_id)
            want += [(i, at, tuple(ids[at : at + length])) for at in range(0, len(ids), length)]
    key = lambda p: (p[0] is None, p[0] or 0, p[1:])
    assert sorted(pieces, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", PACKERS)
@pytest.mark.parametrize("partitions", [1, 6])
def test_round_trip(spark, name, partitions):
    docs = make_docs()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], SCHEMA).repartition(partitions)
    rows = PACKERS[name](df, length=256).collect()
    check_windows(rows, docs, 256, packing.END_ID)
    total = sum(r.n_tokens for r in rows)
    assert total / (256 * len(rows)) > 0.9
    assert PACKERS[name](df.limit(0), length=256).count() == 0


def test_best_fit_decreasing_against_a_plain_search():
    rng = random.Random(4)
    for _ in range(50):
        lengths, rooms = [rng.randrange(1, 33) for _ in range(rng.randrange(1, 80))], []
        for n in sorted(lengths, reverse=True):
            best = min((w for w, room in enumerate(rooms) if room >= n), key=lambda w: rooms[w], default=None)
            if best is None:
                rooms.append(32 - n)
            else:
                rooms[best] -= n
        got = packing.best_fit_decreasing(np.array(lengths), 32)
        assert sorted(i for w in got for i in w) == list(range(len(lengths)))
        # Which of several windows with equal room is taken shows in no fill.
        assert sorted(32 - sum(lengths[i] for i in w) for w in got) == sorted(rooms)


def test_open_windows_are_bounded_and_best_fit():
    state = packing.OpenWindows(10, 2)
    piece = lambda n: (0, 0, np.zeros(n))
    assert state.place(piece(10)) is not None and not state.open
    assert state.place(piece(6)) is None and state.place(piece(7)) is None
    assert state.place(piece(3)) is not None  # fills the 7
    assert state.place(piece(7)) is None and len(state.open) == 2
    closed = state.place(piece(8))
    assert [len(p[2]) for p in closed] == [7] and len(state.open) == 2


def test_id_matrix_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in make_docs()], SCHEMA).coalesce(1)
    packing.write_id_matrices(packing.pack_best_fit_decreasing(df, length=128), str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    (file,) = (tmp_path / "m").glob("*.parquet")
    matrix = packing.read_id_matrix(str(file), tokens.tokenizer(RANKS).n_ids)
    assert matrix.shape == (len(rows), 128) and {r.tobytes() for r in matrix} == {bytes(r.ids) for r in rows}


def test_ends_of_many_tasks_are_merged(spark):
    docs = [(i, " ".join(["alpha beta"] * (1 + i * 37 % 60))) for i in range(400)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], SCHEMA).repartition(100)
    for name in PACKERS:
        rows = PACKERS[name](df, length=512).collect()
        check_windows(rows, docs, 512, packing.END_ID)
        assert sum(r.n_tokens for r in rows) / (512 * len(rows)) > 0.95, name


def test_online_packing_against_its_definition():
    """Best fit, earliest of equal ones; where nothing fits and all are open, the fullest goes, earliest of equal ones."""
    rng = random.Random(9)
    for _ in range(50):
        most, state, windows, closed, got = rng.randrange(1, 6), None, [], [], []
        state = packing.OpenWindows(20, most)
        for k in range(120):
            n = rng.randrange(1, 21)
            done = state.place((k, 0, np.zeros(n)))
            if done is not None:
                got.append([p[0] for p in done])
            room = lambda w: 20 - sum(m for _, m in w)
            fits = [w for w in windows if room(w) >= n]
            if n == 20:
                closed.append([k])
            elif fits:
                best = min(fits, key=room)
                best.append((k, n))
                if room(best) == 0:
                    windows.remove(best)
                    closed.append([i for i, _ in best])
            else:
                if len(windows) == most:
                    fullest = min(windows, key=room)
                    windows.remove(fullest)
                    closed.append([i for i, _ in fullest])
                windows.append([(k, n)])
        assert got == closed


def test_ties_keep_their_order():
    assert packing.best_fit_decreasing(np.array([5, 5, 5, 5]), 10) == [[0, 1], [2, 3]]
    assert packing.best_fit_decreasing(np.array([7, 7, 3, 3]), 10) == [[0, 2], [1, 3]]
