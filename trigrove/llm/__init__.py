"""Operations of a training-data pipeline over tables of documents and web pages.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame; :mod:`.queries` binds them to the tables of a
directory with production parameters.
"""
