"""Reading and writing of collections."""
