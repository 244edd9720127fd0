"""Operations of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Each operator lives in a
module of its own; ``queries`` binds them to the tables and to their SQL.
"""
