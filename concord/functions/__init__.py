"""functions of the declared-versus-observed engine."""
