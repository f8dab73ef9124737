"""The change applier against a version that takes row by row, in order."""

import datetime
import math
import random
import zlib

import pytest

from seqloom.llm import changes

SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, n long, day int, rank string"
DAY = datetime.datetime(1970, 1, 1)


def brute(rows):
    rows = list(dict.fromkeys(rows))
    rank = {}
    for client in {r[1] for r in rows}:
        numbers = sorted({r[2] for r in rows if r[1] == client}, key=lambda x: (x is not None, x or 0))
        rank |= {(client, x): i + 1 for i, x in enumerate(numbers)}
    batches = {b: [] for b in range(1, 13)}
    for r in rows:
        if r[0] is None or r[4] is None or (h := zlib.crc32(str(r[0]).encode())) % 11 == 0:
            continue
        day = (r[4] - DAY).days + 9 * (h % 4)
        batches[max(1, min(12, 1 + math.floor((day - 19723) * 12 / 160)))].append((day, r[0], rank[r[1], r[2]], r[1], r[3], r[7], r[8]))
    following, held, value, out, final, top = {}, {}, {}, [], {}, None

    def run(c, batch, missed=0):
        while following[c] in held[c]:
            n = following[c]
            _, change, op, city, balance = held[c].pop(n)
            old = value.get(c, (None, None))
            value[c] = {"I": (city, balance), "U": (old[0] if city is None else city, old[1] if balance is None else balance), "D": (None, None)}.get(op, old)
            out.append([change, c, "applied", batch, missed, value[c][0], None if value[c][1] is None else math.floor(100 * value[c][1] + 0.5), False])
            final[c] = (len(out) - 1, op != "D")
            following[c], missed = n + 1, 0

    def expire(batch, limit):
        for c in held:
            while held[c] and (limit is None or min(x[0] for x in held[c].values()) + 3 <= limit):
                n = min(held[c])
                missed, following[c] = n - following[c], n
                run(c, batch, missed)

    for batch, own in batches.items():
        if top is not None:
            expire(batch, top)
        for day, change, n, c, op, city, balance in sorted(own, key=lambda x: x[:2]):
            following.setdefault(c, 1), held.setdefault(c, {})
            if n in held[c] or n < following[c]:
                out.append([change, c, "rejected", batch, 0, None, None, False])
            else:
                held[c][n] = (day, change, op, city, balance)
                run(c, batch)
        top = max([x[0] for x in own] + ([] if top is None else [top]), default=None)
    expire(13, None)
    for at, stands in final.values():
        out[at][7] = stands
    return sorted((tuple(x) for x in out), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def history(seed, clients, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        client = rng.choice(clients)
        at = DAY + datetime.timedelta(days=19720 + rng.random() * rng.choice([5, 160]))
        seq = rng.choice([i // 3, rng.randrange(60), None if rng.random() < 0.02 else i])
        rows.append((i, client, seq, rng.choice(["I", "U", "U", "U", "D", None, "X"]), None if rng.random() < 0.03 else at, "s", None, rng.choice([None, "Ä", "b"]), rng.choice([None, -1.005, 2.675, 1e6, 0.0])))
    late = [(n + i, 6, i, 'I', DAY + datetime.timedelta(days=19900) if i else None, None, None, 'z', 1.5) for i in range(6)]
    return [*rows, *late, *rng.sample(rows, n // 10), (None, 1, 1, "I", DAY, None, None, None, None)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, 9, "x") for r in rows], SCHEMA).repartition(3)


def test_changes_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(changes, "BLOCK", 8)
    rows = history(1, [0, 1, 1, 1, 1, 2, 3, None], 500)
    want = brute(rows)
    assert {x[2] for x in want} == {"applied", "rejected"} and {1, 12, 13} <= {x[3] for x in want} and any(x[4] for x in want) and any(x[7] for x in want)
    assert got(changes.apply_changes(table(spark, rows))) == want


def test_one_client_and_calls_apart(spark):
    rows = history(2, [5], 120)
    assert got(changes.apply_changes(table(spark, rows))) == brute(rows)
    few = [r for r in rows if r[4] is not None][:1]
    assert got(changes.apply_changes(table(spark, few))) == brute(few)


def test_no_changes(spark):
    frame = changes.apply_changes(spark.createDataFrame([], SCHEMA))
    assert frame.count() == 0 and frame.columns == ["change_id", "client_id", "status", "batch", "missed", "city", "cents", "current"]


@pytest.mark.parametrize("seed", range(30))
def test_wheel_without_spark(seed):
    """Slots that are due and only they are visited; a client is always in the slot of its earliest held day."""
    rng, wheel, tick = random.Random(seed), changes.Wheel(), None
    for batch in range(1, 9):
        visited = []
        jump = wheel.jump
        wheel.jump = lambda c, d, b, jump=jump, visited=visited: (visited.append(c), jump(c, d, b))[1]
        due = {c for c, slot in wheel.due.items() if tick is not None and slot <= tick}
        list(wheel.tick(tick, batch))
        assert set(visited) == due
        del wheel.jump
        for client in ((True, 1), (True, 2), (False, 0)):
            list(wheel.arrive(client, [(10 * batch + rng.randrange(12), rng.randrange(1000), rng.randrange(1, 40), "U", None, 1.0) for _ in range(rng.randrange(6))], batch))
        tick = 10 * batch + 11
        wheel = changes.Wheel.load(wheel.dump())
        assert wheel.due == {c: min(x[0] for x in h.values()) + changes.PATIENCE for c, h in wheel.held.items() if h}
        assert {c: s for s, own in wheel.slots.items() for c in own} == wheel.due
