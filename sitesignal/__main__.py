import sys

from sitesignal.cli import main

sys.exit(main())
