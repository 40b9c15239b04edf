"""What statements do: queries, mutations, plan reports."""
