"""A sequential model of the fold, and random logs for it."""

import random


def ops_frame(spark, rows):
    """rows: (seq, op_idx, ns, op, key, value, expected_seq)"""
    return spark.createDataFrame(rows, "seq long, op_idx int, ns int, op string, key binary, value binary, expected_seq long")


def random_ops(n, seed, keys=12, cas=True):
    """40% insert, 20% update, 15% delete, the rest conditional sets with fresh, stale or foreign expectations."""
    r, rows, last = random.Random(seed), [], {}
    for seq in range(1, n + 1):
        key = f"k{r.randrange(keys)}".encode()
        kind = r.random()
        if kind < 0.6 or not cas:
            rows.append((seq, 0, 1, "set", key, f"v{seq}".encode(), 0))
        elif kind < 0.75:
            rows.append((seq, 0, 1, "delete", key, None, 0))
        else:
            seen = last.get(key, [0])
            expect = r.choice([seen[-1], seen[-1], seen[-1], r.choice(seen), r.randrange(1, seq + 1)]) or 1
            rows.append((seq, 0, 1, "set", key, f"c{seq}".encode(), expect))
        last.setdefault(key, []).append(seq)
    return rows


def fold(rows):
    """Per seq: ok and effects; and the state at the end."""
    state, ok, effects = {}, {}, []
    by_seq = {}
    for row in sorted(rows):
        by_seq.setdefault(row[0], {})[(row[2], row[4])] = row
    for seq in sorted(by_seq):
        ops = by_seq[seq].values()
        ok[seq] = all(o[6] == 0 or state.get((o[2], o[4]), (None,))[0] == o[6] for o in ops)
        if not ok[seq]:
            continue
        for _, i, ns, op, key, value, _ in ops:
            before = state.get((ns, key), (None, None))[1]
            effects.append((seq, i, ns, key, "delete" if op == "delete" else "update", before, None if op == "delete" else value))
            if op == "delete":
                state.pop((ns, key), None)
            else:
                state[ns, key] = (seq, value)
    return ok, effects, state
