"""Training-data operators for very large corpora.

One module per operator (``op1_...`` to ``op10_...``); ``kernels`` holds the
numpy text kernels they share, ``stages`` the shared-folder helpers and
``catalogue`` the registered queries with their SQL.
"""
