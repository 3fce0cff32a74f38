"""Whole queries: timeline, digest, topics, connections, search, people, itinerary, status. Each is one DataFrame plan."""
