"""Building blocks that shape physical plans: staging tables, bounded broadcasts, global order, skew-safe joins."""
