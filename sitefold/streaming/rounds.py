"""The round barrier as a stateful stream: one message per site and round, last one wins, a round is
released when every expected site reported, and named as incomplete when it times out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "round int, status string, missing string, vec array<double>, weight double"
STATE = "sites array<string>, seqs array<bigint>, weights array<double>, vecs array<array<double>>, released boolean"


def round_barrier(messages: DataFrame, sites: Sequence[str], timeout: str | None = None) -> DataFrame:
    """messages(round, site, seq, weight, vec): seq orders repeated messages of one site, unknown
    sites are reported and ignored. State per round holds at most one vector per expected site."""
    expected = sorted(sites)
    allowed = set(expected)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        rnd = int(key[0])
        held: dict = {}
        released = False
        if state.exists:
            names, seqs, weights, vecs, released = state.get
            held = {s: (q, w, list(v)) for s, q, w, v in zip(names, seqs, weights, vecs)}
        if state.hasTimedOut:
            missing = [s for s in expected if s not in held]
            state.remove()
            if not released:
                yield pd.DataFrame([(rnd, "incomplete", ",".join(missing), None, None)], columns=["round", "status", "missing", "vec", "weight"])
            return
        out = []
        for pdf in frames:
            for m in pdf.itertuples(index=False):
                if m.site not in allowed:
                    out.append((rnd, "rejected", m.site, None, None))
                elif m.site not in held or m.seq >= held[m.site][0]:
                    held[m.site] = (int(m.seq), float(m.weight), [float(v) for v in m.vec])
        if not released and len(held) == len(expected):
            total = sum(w for _, w, _ in held.values())
            vec = [sum(w * v[i] for _, w, v in held.values()) / total for i in range(len(held[expected[0]][2]))]
            out.append((rnd, "complete", "", vec, total))
            released = True
        order = sorted(held)
        state.update((order, [held[s][0] for s in order], [held[s][1] for s in order], [held[s][2] for s in order], released))
        if timeout is not None:
            state.setTimeoutDuration(int(timeout))
        if out:
            yield pd.DataFrame(out, columns=["round", "status", "missing", "vec", "weight"])

    mode = GroupStateTimeout.NoTimeout if timeout is None else GroupStateTimeout.ProcessingTimeTimeout
    return messages.groupBy("round").applyInPandasWithState(step, OUTPUT, STATE, "append", mode)
