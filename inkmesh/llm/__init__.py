"""Operators for preparing language-model training corpora.

Each module holds one operator with its own general interface; ``queries``
holds the thin ``opN_<name>`` queries built on them.  Nothing outside this
subpackage imports it.
"""
