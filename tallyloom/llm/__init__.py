"""Operations of a training-data pipeline: ten operators and their registered queries.

Nothing outside this folder imports it.
"""
