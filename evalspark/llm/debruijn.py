"""Removing long repeated word sequences by anchored runs of word windows, in place of a de
Bruijn graph.

Every window of W words would be an edge of the graph. A row per edge would be larger than the
corpus, so no graph is built: there are no nodes and no degrees. Windows that follow each other
in a text and share their anchor are one run (see ``repeats``), hashed once. Joins on anchors
and run hashes then do the work: a run that occurs twice is repeated as a whole; only where
runs with one anchor differ are they cut into their single windows, which are counted by place
and hash. Repeated runs and windows are taken back to their source coordinates, and neighbouring
ones close up to the long repeated spans of each text. Equality rests on hashes; the words at
the coordinates are not compared (figures in the README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from evalspark.llm.repeats import Repeats, compare_windows

WINDOW = 35
GRAM = 8


def cut_edges(repeats: Repeats, classes: DataFrame) -> DataFrame:
    return compare_windows(repeats, classes, repeats.branchings(classes))


def drop_repeats(docs: DataFrame, *keep: str, text_col: str = "text", window: int = WINDOW, gram: int = GRAM, as_is: bool = False) -> DataFrame:
    """(_row, n_units, n_removed, kept, spans) per input row: the words that stay after every
    word of a ``window``-word sequence that also starts elsewhere is gone, joined by one space.

    ``_row`` holds the columns ``keep``. Null and blank texts have no words. Texts of fewer
    words than the window lose nothing; of repeated rows all lose everything from that length
    on. With ``as_is``, texts that lose nothing keep their blanks. Windows are judged on the input, take words unchanged and may overlap.
    """
    return Repeats(docs, text_col, window, gram, words=True).cut(cut_edges, *keep, as_is=as_is)
