"""Diagnosis codes given to parts, so that every rule branch is met."""

# one or more per rule branch, shadowed, out of range, dotted, undotted, unknown, missing
CODES = (
    "R52", "G894", "R1084", "M545", "M549", "N200", "S89001", "S90012", "S99921", "S9911",
    "N644", "R070", "R071", "R0789", "R079", "H9201", "H5711", "R51", "G43909", "G43911",
    "M25551", "M2551", "M79604", "R102", "M542", "K146", "K0889", "N23", "F4541", "F329",
    "F3341", "Z794", "E119", "E0800", "I5022", "I509", "40201", "4281", "I2510", "N179", "N186",
    "M810", "J449", "I64", "I6940", "I639", "Z12.11", "C50.911", "C50911", "C55", "R11.0",
    "R52.1", "Z0000", None,
)
