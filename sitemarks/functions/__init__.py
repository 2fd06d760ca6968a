"""Expression functions, all evaluated in the JVM.

Arguments are SQL expressions (most often a column name). Functions named
``*_sql`` return SQL text to be nested in other expressions; the others return a
Column. Large expressions are composed as text because that is one call into the
JVM instead of thousands.
"""
