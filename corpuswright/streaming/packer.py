"""A stream of tokenized documents, packed into sequences of fixed length as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as C


def packed_stream(df: DataFrame, context: int = C.CONTEXT, part: str = "source", tokens: str = "tokens") -> DataFrame:
    """part, seq, tokens (context of them), in append mode. df: a stream of part and tokens (end markers included).

    Documents of a part are joined in the order in which they come; what doesn't fill a sequence waits in
    the state, less than context tokens for each part, so that the rest of a part is written when more of it
    comes. The number of a sequence goes on over restarts, as the state is checkpointed. A null part is
    one of its own; documents with null tokens hold none."""

    def pack(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seq = state.get if state.exists else ([], 0)
        held, out = list(held), []
        for pdf in frames:
            for ids in pdf[tokens]:
                held.extend(() if ids is None else ids)
                whole = len(held) // context
                out += [(key[0], seq + k, held[k * context : (k + 1) * context]) for k in range(whole)]
                held, seq = held[whole * context :], seq + whole
        state.update(([int(t) for t in held], seq))
        yield pd.DataFrame(out, columns=[part, "seq", "tokens"])

    rows = df.select(part, tokens)
    kind = dict(df.dtypes)[part]
    return rows.groupBy(part).applyInPandasWithState(pack, f"`{part}` {kind}, seq long, tokens array<int>", "held array<int>, seq long", "append", GroupStateTimeout.NoTimeout)
