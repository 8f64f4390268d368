"""Main text of web pages by minimum cuts.

Each text block of a page is a node. A rule-based classifier (region hints, link share, length, sentence ends) gives the
cost of calling it boilerplate (capacity from the source) or content (capacity to the sink); neighbours in page order and in the
element tree are joined by smoothness edges, weak across the border of a menu, advert, form or comment region. The minimum cut
labels all blocks at once; blocks that can't reach the sink any more are content.

Defined cases: null or empty html gives an empty text; markup without any text too; repeated pages each keep their row; null ids and urls
stay; extra columns are not read. Pages are worked on one at a time, so memory is bounded by the longest page of a batch.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from lagwell.llm.markup import Block, read

#: Weights of the classifier (log-odds of content) and of the edges, times 100.
REGION_AWAY, REGION_HOME, HEADING, LONG, SHORT, SENTENCE, LINKS, NEAR, SIBLING, ACROSS = 900, 500, 100, 200, 60, 80, 350, 60, 40, 5
_ENDS = tuple(".!?…。！？”\"'»):;")


def cost(b: Block) -> int:
    """Log-odds that a block is content: positive costs are capacities from the source, negative ones to the sink."""
    c = (REGION_HOME if b.home else 0) - (REGION_AWAY if b.away else 0)
    c += HEADING if b.tag in ("h1", "h2", "h3") else 0
    c += max(-SHORT, min(LONG, 3 * len(b.text) - 120))
    c += SENTENCE if b.text.endswith(_ENDS) else 0
    return c - int(LINKS * b.linked)


def edges(blocks: list[Block]) -> list[tuple[int, int, int]]:
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            out.append((i - 1, i, ACROSS if a.away != b.away else NEAR if a.home == b.home else ACROSS * 4))
        if b.parent in last and last[b.parent] != i - 1 and blocks[last[b.parent]].away == b.away:
            out.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return out


def content(costs: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Minimum cut by blocking flows: True for nodes that don't reach the sink in the residual network."""
    n = len(costs)
    excess, room = [max(c, 0) for c in costs], [max(-c, 0) for c in costs]
    to: list[list[int]] = [[] for _ in range(n)]
    end, cap = [], []
    for a, b, w in links:
        to[a].append(len(end))
        end.append(b), cap.append(w)
        to[b].append(len(end))
        end.append(a), cap.append(w)

    def distances() -> list[int]:
        far = [-1] * n
        queue = deque(i for i in range(n) if room[i])
        for i in queue:
            far[i] = 0
        while queue:
            v = queue.popleft()
            for e in to[v]:
                u = end[e]
                if far[u] < 0 and cap[e ^ 1]:
                    far[u] = far[v] + 1
                    queue.append(u)
        return far

    while True:
        far = distances()
        if not any(excess[i] and far[i] >= 0 for i in range(n)):
            return [d < 0 for d in far]
        step = [0] * n
        for s in range(n):
            while excess[s] and far[s] >= 0:
                path, v = [], s
                while far[v] or not room[v]:
                    while step[v] < len(to[v]):
                        e = to[v][step[v]]
                        if cap[e] and far[end[e]] == far[v] - 1 and far[v] > 0:
                            break
                        step[v] += 1
                    else:
                        if not path:
                            break
                        v = end[path.pop() ^ 1]
                        step[v] += 1
                        continue
                    path.append(e)
                    v = end[e]
                else:
                    flow = min([excess[s], room[v], *(cap[e] for e in path)])
                    excess[s] -= flow
                    room[v] -= flow
                    for e in path:
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                    continue
                break


def main_text(source: str | None) -> str:
    blocks = read(source or "").blocks
    keep = content([cost(b) for b in blocks], edges(blocks)) if blocks else []
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 500):
                b = batch.slice(i, 500)
                text = [main_text(x) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
