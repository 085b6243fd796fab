"""Operators for preparing language-model training corpora.

Each module holds one operator with a general ``DataFrame -> DataFrame``
interface; ``queries`` holds the registered ``opN_<name>`` queries (thin digests
of the operators' results) and ``oracle`` the DuckDB statements of those that
SQL can express. Nothing outside this subpackage imports it.
"""
