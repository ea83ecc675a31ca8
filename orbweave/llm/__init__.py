"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface; :mod:`orbweave.llm.queries` applies them to the shared tables.
"""
