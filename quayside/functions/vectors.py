"""Fixed values of the default embedder.

Tokens are maximal runs of [0-9a-z] after lower-casing; a token's bucket is
the first four hex digits of its MD5 read as an integer, modulo the
dimension; the vector is the L2-normalised bucket count.  The DuckDB twin
(``plans/documents.EMB_SQL``) computes the same vector.
"""

TOKEN_RE = "[0-9a-z]+"
DIM = 64
