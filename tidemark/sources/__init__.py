"""Where archives are kept, and how changes travel: a versioned store, and the frame codec with its Spark source."""
