"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from . import base
from . import answering, content, documents, flows, lifecycle, people, processing, questions, recaps, relational, search, segments, stitching, transcripts, views  # noqa: F401

FLAGSHIP = "contact_stats"


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.SQL)
