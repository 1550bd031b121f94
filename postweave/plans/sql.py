"""An archive to SQL: a view of each table, and table functions over the views.

The functions are SQL functions, whose bodies the optimizer sees: a list given as a literal reaches the scan, and
functions called for each row of a table (LATERAL) become joins on the list and the number. Nothing is computed
before a query asks for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.register import create_functions

MESSAGE = "msgnum INT, subject STRING, name STRING, email_addr STRING, date BIGINT"

#: Name: (parameters, columns, body). Of parameters with a default, null asks for all.
TABLE_FUNCTIONS = {
    "thread_walk": ("list STRING DEFAULT NULL", "list_id STRING, root INT, msgnum INT, depth INT, ord INT, shown BOOLEAN",
                    "SELECT list_id, root, msgnum, depth, ord, shown FROM thread_index WHERE list IS NULL OR list_id = list"),
    "thread_of": ("list STRING, num INT", f"ord INT, depth INT, {MESSAGE}",
                  """SELECT t.ord, t.depth, m.msgnum, m.subject, m.name, m.email_addr, m.date FROM thread_index h
JOIN thread_index t ON t.list_id = h.list_id AND t.root = h.root JOIN messages m ON m.list_id = t.list_id AND m.msgnum = t.msgnum
WHERE h.list_id = list AND h.msgnum = num"""),
    "replies_to": ("list STRING, num INT", f"seq BIGINT, maybe_reply INT, kind STRING, {MESSAGE}",
                   """SELECT e.seq, e.maybe_reply, e.kind, m.msgnum, m.subject, m.name, m.email_addr, m.date FROM reply_edges e
JOIN messages m ON m.list_id = e.list_id AND m.msgnum = e.child_msgnum WHERE e.list_id = list AND e.parent_msgnum = num"""),
    "messages_between": ("list STRING, since STRING, until STRING", MESSAGE,
                         """SELECT m.msgnum, m.subject, m.name, m.email_addr, m.date FROM messages m
WHERE m.list_id = list AND m.date > 0 AND m.date >= parse_mail_date(since) AND m.date < parse_mail_date(until)"""),
}
#: Views that the functions read.
NEEDED = ("messages", "reply_edges", "thread_index")


def create_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """A temporary view of each table under its name, then the functions of one value and those above.

    A table that a function reads and that isn't given is an error. messages_between takes dates as mails write them;
    undated messages are in no range, and of a date that can't be read the range begins, or ends, in 1970."""
    if missing := [n for n in NEEDED if n not in tables]:
        raise ValueError(f"no table {', '.join(missing)}")
    for name, rows in tables.items():
        rows.createOrReplaceTempView(name)
    create_functions(spark)
    for name, (parameters, columns, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
