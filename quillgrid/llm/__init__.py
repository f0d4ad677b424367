"""Operators for preparing training corpora.

The rest of the library never imports this subpackage; it can be removed as a
whole.  Each module holds one operator with a general DataFrame interface, and
``queries.py`` holds the thin registered queries.
"""
