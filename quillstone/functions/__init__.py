"""Types of the dialect and the Column builders that carry its rules."""
