"""All bound queries."""

from . import batches, corpus, graphs, rewards, rollouts, statistics, storage, streams  # noqa: F401
from .common import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
