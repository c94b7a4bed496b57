"""Operations of a training-data pipeline: thirteen operators over text, vector and page tables.

Nothing else in the library imports this subpackage. Each module has one operator with a general
interface; :mod:`scribewell.llm.queries` registers one ``opN_<name>`` query for each.
"""
