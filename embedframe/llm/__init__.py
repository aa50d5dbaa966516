"""Operators for preparing training corpora.  Nothing else in the library imports this package.

Python tasks import this package, so ship it to executors (``PYTHONPATH`` or ``--py-files``).
"""
