"""Report queries over the gold tables, one module per subject.

Every function takes gold DataFrames and returns a lazy DataFrame. The filters' defaults select
everything, or what the published screens show at first. Ties are broken by name, so a report
is the same in every run. Means of group means are unweighted unless the function says otherwise.
"""
