"""Requests and responses of one connection put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordering import numbered


def pair_in_order(requests: DataFrame, responses: DataFrame, conn: list[str], order: list[str]) -> DataFrame:
    """The k-th request of a connection with its k-th response: conn, depth, request, response (structs, null if missing).

    Both sides have conn and order columns, the first of order a number or a time. Null conn values pair with none. A
    connection that holds most rows is numbered by ranges of the order, see ordering.numbered().
    """

    def ranked(df: DataFrame, name: str) -> DataFrame:
        return numbered(df, conn, order, "depth").select(*conn, "depth", F.struct(*df.columns).alias(name))

    return ranked(requests, "request").join(ranked(responses, "response"), [*conn, "depth"], "full")


def pair_by_transaction(queries: DataFrame, responses: DataFrame, conn: list[str], txid: str, order: list[str]) -> DataFrame:
    """Queries and responses of the same transaction id, the k-th use of an id with its k-th response, in either order.

    Unmatched ones are kept with a null partner: conn, txid, nth, query, response.
    """

    def ranked(df: DataFrame, name: str) -> DataFrame:
        return numbered(df, [*conn, txid], order, "nth").select(*conn, txid, "nth", F.struct(*df.columns).alias(name))

    return ranked(queries, "query").join(ranked(responses, "response"), [*conn, txid, "nth"], "full")


def packets_of(packets: DataFrame, matched: DataFrame, key: list[str]) -> DataFrame:
    """All packets of the matched connections."""
    return packets.join(matched.select(*key), key, "left_semi")
