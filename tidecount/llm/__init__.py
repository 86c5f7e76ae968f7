"""Operations for large training corpora.

Nothing outside this subpackage imports it. Every module holds one operator with
its own general interface; ``queries`` derives the registered ``opN_*`` results.
"""
