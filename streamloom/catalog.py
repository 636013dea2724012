"""The queries of the encoding and profiling operators by name, with the SQL that checks them."""

from streamloom.plans import encodings, reports

QUERIES = {**encodings.QUERIES, **reports.QUERIES}
SQL = {**encodings.SQL, **reports.SQL}
