"""Arrays over streams: elementwise operations, slices, transposes and combinations of
streamed cells are projections, filters and unions, which streaming queries run as they
are. What needs all cells at once is refused."""

from __future__ import annotations

from tessera.array import LazyArray
from tessera.plans import nodes


def stream_df(x: LazyArray):
    """The streaming relation of ``x``; an error if an operation can't run on a stream."""
    todo = [x.node]
    while todo:
        node = todo.pop()
        if isinstance(node, nodes.Reduce | nodes.Binary) or (isinstance(node, nodes.WithArgs) and node.seed.implicit and not node.implicit):
            raise NotImplementedError(f"{type(node).__name__} can't run on a stream")
        todo += nodes.children(node)
    df = x.to_df()
    if not df.isStreaming:
        raise ValueError("the array's cells are no stream")
    return df
